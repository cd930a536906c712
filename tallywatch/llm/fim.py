"""Fill-in-the-middle transformation of documents.

A text is a row of units: white space with the word after it, or white space at the end. One
full match of ``(unit)*`` keeps the end of every repetition, so the number of units and the offsets
of both cuts come from the one match. A seeded hash of the id draws the cuts and the form: the text
as it is (``plain``), or prefix, middle and suffix behind sentinels in one of two orders (``psm``,
``spm``). ``transform`` returns the transformed texts, ``restore`` rebuilds the originals from text
and form alone.

Defined results: a null or empty text is plain, has no units and an empty output; a text that
holds a sentinel is plain; a null id draws as the text 'null', so equal ids draw equal cuts; bytes
that are no UTF-8 pass through unchanged; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import documents

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
UNITS = regex.compile(rf"({SPACE}*{WORD}+|{SPACE}+)*")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE = 50  # percent of the documents that are transformed
SPM = 80  # percent of these that begin with the suffix
SEED = 42
DRAWS = 4
OUTPUT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"


def draws(doc_id: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    groups = (F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(DRAWS))
    return F.array(*groups)


def cut(text: str, drawn: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the transformed text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or drawn[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = (ends[k - 1] if k else 0 for k in sorted((drawn[0] % (n + 1), drawn[1] % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if drawn[3] % 100 < spm:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _task(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rate: int, spm: int) -> Iterator[pa.RecordBatch]:
    """A batch is bounded in bytes by Spark; one text at a time becomes a string."""
    for batch in batches:
        rows = []
        for text, drawn in zip(batch.column("text"), batch.column("draws")):
            whole = (text.as_py() or b"").decode("utf-8", "surrogateescape")
            *found, output = cut(whole, drawn.as_py(), rate, spm)
            rows.append((*found, output.encode("utf-8", "surrogateescape")))
        columns = list(zip(*rows)) or [()] * 5
        made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=schema)


def transform(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (the transformed text) of every document."""
    if not (0 <= rate <= 100 and 0 <= spm <= 100):
        raise ValueError("rate and spm are percentages")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), draws(F.col("doc_id"), seed).alias("draws"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(partial(_task, schema=names, rate=rate, spm=spm), f"doc_id {kind}, {OUTPUT}")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. Sentinels cannot overlap text around them, so the first of each cuts."""

    def after(whole: Column, mark: str) -> Column:
        return F.substr(whole, F.instr(whole, F.lit(mark)) + len(mark))

    def before(whole: Column, mark: str) -> Column:
        return F.substr(whole, F.lit(1), F.instr(whole, F.lit(mark)) - 1)

    first = F.substr(output, F.lit(len(PREFIX) + 1))  # behind the leading sentinel
    psm = F.concat(before(first, SUFFIX), after(first, MIDDLE), before(after(first, SUFFIX), MIDDLE))
    spm = F.concat(before(after(first, PREFIX), MIDDLE), after(first, MIDDLE), before(first, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def restore(transformed: DataFrame) -> DataFrame:
    """The rows of ``transform`` with the original text (empty where it was null) as ``text``."""
    return transformed.withColumn("text", restored(F.col("output"), F.col("form")))


def op11_fill_in_middle(spark, folder: str) -> DataFrame:
    made = restore(transform(documents(spark, folder)))
    digests = (F.sha2(F.col(c).cast("binary"), 256).alias(name) for c, name in (("output", "output_sha256"), ("text", "restored_sha256")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = r"""
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, text,
        CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') END AS units,
        CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM hashed
), formed AS (
    SELECT *, CAST(len(units) AS BIGINT) AS n,
        least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT doc_id, text, n, form,
        array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
        array_to_string(units[high + 1:], '') AS suffix
    FROM formed
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""

"""Quality rules from tokeniser fertility.

Public vocabularies measure each text: characters per token and the entropy of its tokens
(relative to the largest possible) with the byte-level one, and the share of byte-fallback tokens
with the one that falls back to bytes. A language, or the script where a language is rare or
unknown, has a band for each measure, taken from the quartiles of all its documents that pass the
base rules: far beyond them a text is rejected. Where neither has enough documents for quartiles
there is no band, and the base rules alone decide.

Judged are the tokens with a letter or a digit, since signs say nothing about a language. Entropy
falls with the length of a text, so what counts is its distance from the trend of the group: bits
per token on one line over 1 / log2(tokens), through the medians of the length classes. Short texts
vary more: all distances shrink by their length before quartiles and fences are applied.

Defined results: a null text has no words and fails the base rules; equal rows get equal verdicts;
a null language is judged by its script; an empty table gives no rows; extra columns are ignored
(kept by ``kept_documents``), whatever their names.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import documents, small_batches, stored
from tallywatch.llm.pieces import default_paths, flat, give_back, portions, token_ids, word_codes, words_of

LEAST_WORDS = 10
MOST_REPEATED = 20  # percent
WINDOW = 5
# Interquartile ranges beyond the lower and the upper quartile. Noise has few characters per token;
# many of them only mark common words.
FENCE = {"lettered_chars": (2.25, 6.0), "byte_share": (4.0, 4.0), "lettered_entropy": (3.5, 4.0)}
SHORT = 1024  # tokens; below, distances shrink with the square root
LEAST_GROUP = 20  # documents, for quartiles
# First words in the names of letters that do not name a script, or only with the next word.
HALF_NAMES = {"OLD", "NEW", "TAI", "LINEAR", "INSCRIPTIONAL"}
NO_SCRIPT = {
    "MODIFIER", "MATHEMATICAL", "FEMININE", "MASCULINE", "MICRO", "OHM", "KELVIN", "ANGSTROM", "SCRIPT", "DOUBLE-STRUCK",
    "BLACK-LETTER", "COMBINING", "VARIATION", "IDEOGRAPHIC", "VERTICAL", "CARON", "SUPERSCRIPT", "ROMAN", "MASU", "VEDIC",
    "MUSICAL", "ALEF", "BET", "GIMEL", "DALET", "INFORMATION", "TURNED",
}
SAME_SCRIPT = {"hiragana": "kana", "katakana": "kana", "katakana-hiragana": "kana", "cjk": "han"}
MEASURES = ("lettered_chars", "byte_share", "lettered_entropy")
# The least spread of a measure that counts as one range, so a group of like texts is not overstrict;
# that of the characters per token is a share of the usual number.
LEAST_SPREAD = {"lettered_chars": 0.01, "byte_share": 0.006, "lettered_entropy": 0.01}
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint"
METRICS = COUNTS + ", chars_per_token double, byte_share double, entropy double, script string"
METRICS += ", n_lettered bigint, lettered_chars double, lettered_entropy double"


@functools.cache
def _fallback(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


@functools.cache
def _signs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Of every token: whether it is ASCII without a letter or digit, and then its characters but white space."""
    with open(path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    signs, chars = np.zeros(65_536, bool), np.zeros(65_536, np.int64)
    for token, text in ranks.items():
        signs[token] = text.isascii() and not any(c.isalnum() for c in text.decode())
        chars[token] = signs[token] * len(b"".join(text.split()))
    return signs, chars


def repeated_words(codes: np.ndarray, owner: np.ndarray, texts: int, window: int = WINDOW) -> np.ndarray:
    """Per text, the words in windows of ``window`` words that occur twice or more in it."""
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(texts, np.int64)
    at = np.flatnonzero(owner[:n] == owner[window - 1 :])
    mixed = owner[at].astype(np.uint64)
    for k in range(window):
        mixed = (mixed ^ codes[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = owner[a] == owner[b]
        for k in range(window):
            same &= codes[a + k] == codes[b + k]
        return same

    same_hash = mixed[order[1:]] == mixed[order[:-1]]
    first, second = at[order[:-1][same_hash]], at[order[1:][same_hash]]
    if not alike(first, second).all():  # two windows of one hash: sort the windows themselves
        order = np.lexsort([codes[at + k] for k in range(window)] + [owner[at]])
        first, second = at[order[:-1]], at[order[1:]]
        same = alike(first, second)
        first, second = first[same], second[same]
    edges = np.zeros(len(codes) + 1, np.int64)
    starts = np.union1d(first, second)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(owner[covered], minlength=texts)


def _duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


@functools.cache
def _script_table() -> tuple[list[str], np.ndarray]:
    """All scripts, ``other`` first, and the script of every code point: letters and the marks on them
    have its name in theirs."""
    of_names = {"other": 0}
    table = np.zeros(0x110000, np.int16)
    for point in range(0x110000):
        char = chr(point)
        if unicodedata.category(char)[0] in "LM" and (name := unicodedata.name(char, "")):
            first, *rest = name.split(" ")
            if first in NO_SCRIPT:
                continue
            if first in ("FULLWIDTH", "HALFWIDTH"):
                first = rest[0]
            elif first in HALF_NAMES and rest:
                first = f"{first} {rest[0]}"
            script = first.lower()
            table[point] = of_names.setdefault(SAME_SCRIPT.get(script, script), len(of_names))
    return list(of_names), table


def _scripts(texts: list[bytes]) -> list[str]:
    names, table = _script_table()
    out = []
    for text in texts:
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        counts = np.bincount(table[points], minlength=len(names))
        counts[0] = 0
        best = counts.argmax()
        out.append(names[best] if counts[best] else "other")
    return out


def measure(texts: list[bytes], paths) -> dict[str, list]:
    """All counts and measures of some texts."""
    data, bounds = flat(texts)
    starts, ends, owner, n_words = words_of(data, bounds)
    codes, distinct = word_codes(data, starts, ends)
    cells = pa.array(texts, pa.binary()).cast(pa.string())
    chars = np.bincount(owner, weights=_chars(data, starts, ends), minlength=len(texts)).astype(np.int64)
    out = {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": pc.count_substring_regex(cells, "[#*$%&|<>]").to_numpy(),
        "n_dup_lines": np.array([_duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeated_words(codes, owner, len(texts)),
    }
    ids, cuts = token_ids(texts, paths)
    tokens = np.diff(cuts)
    of = np.repeat(np.arange(len(texts)), tokens)
    keys, counts = np.unique(of * 65_536 + ids, return_counts=True)
    key_owner = keys >> 16
    out["n_tokens"] = tokens
    out["chars_per_token"] = np.where(tokens > 0, chars / np.maximum(tokens, 1), 0.0)
    out["entropy"] = _entropies(counts, key_owner, tokens)
    signs, sign_chars = _signs(paths[1])
    lettered = tokens - np.bincount(of, weights=signs[ids], minlength=len(texts)).astype(np.int64)
    rest = chars - np.bincount(of, weights=sign_chars[ids], minlength=len(texts))
    some = ~signs[keys & 65_535]
    out["n_lettered"] = lettered
    out["lettered_chars"] = np.where(lettered > 0, rest / np.maximum(lettered, 1), 0.0)
    out["lettered_entropy"] = _entropies(counts[some], key_owner[some], lettered)

    model, is_byte = _fallback(paths[3])
    pieces = model.encode([w.decode("utf-8", "replace") for w in distinct.to_pylist()], num_threads=1)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    piece_ids = np.fromiter((i for p in pieces for i in p), np.int64, int(lengths.sum()))
    fallen = np.bincount(np.repeat(np.arange(len(pieces)), lengths), weights=is_byte[piece_ids], minlength=len(pieces))
    all_pieces = np.bincount(owner, weights=lengths[codes], minlength=len(texts))
    all_fallen = np.bincount(owner, weights=fallen[codes], minlength=len(texts))
    out["byte_share"] = np.where(all_pieces > 0, all_fallen / np.maximum(all_pieces, 1), 0.0)
    out["script"] = _scripts(texts)
    return out


def _entropies(counts: np.ndarray, owner: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Entropy of each text relative to the largest possible, from the counts of its distinct tokens."""
    share = counts / tokens[owner]
    bits = np.bincount(owner, weights=-share * np.log2(share), minlength=len(tokens))
    return np.where(tokens > 1, bits / np.log2(np.maximum(tokens, 2)), 0.0)


def _chars(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points per word: bytes that do not continue a character."""
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return (lead[ends] - lead[starts]).astype(np.float64)


def measured(rows: DataFrame, names: list[str], paths=None) -> DataFrame:
    """``names`` and all measures of every row of ``rows``, which also has the column _text."""
    small_batches(rows.sparkSession)
    paths = paths or default_paths()
    base = rows.select(*names).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.fields) + ", " + METRICS
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    kinds = {name: kinds[kind] for name, kind in (f.split() for f in METRICS.split(", "))}
    fields = list(kinds)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("_text").cast(pa.binary()).to_pylist()]
            for low, high in portions(texts):
                found = measure(texts[low:high], paths)
                columns = [batch.column(n).slice(low, high - low) for n in names]
                columns += [pa.array(found[f], kinds[f]) for f in fields]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *fields])
        give_back()

    return rows.select(*names, "_text").mapInArrow(task, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _length() -> Column:
    return F.log2(F.greatest(F.col("n_lettered"), F.lit(2)))


def _usual(groups: DataFrame) -> DataFrame:
    """kind, key, n, the usual value of each measure, and slope: the usual bits per token are
    usual + slope / log2(tokens), by least squares. All are drawn through the medians of the length
    classes, which a few odd texts do not move."""
    classes = groups.groupBy("kind", "key", F.floor(_length()).alias("class")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(1 / _length()).alias("u"),
        *(F.percentile_approx(m, 0.5, 1000).alias(m) for m in MEASURES),
    )
    bits = F.col("lettered_entropy") / F.col("u")
    sums = classes.groupBy("kind", "key").agg(
        F.sum("n").alias("n"),
        *((F.sum(F.col("n") * F.col(m)) / F.sum("n")).alias(f"usual_{m}") for m in MEASURES if m != "lettered_entropy"),
        *(
            (F.sum(F.col("n") * v) / F.sum("n")).alias(name)
            for name, v in (("u", F.col("u")), ("b", bits), ("uu", F.col("u") * F.col("u")), ("ub", F.col("u") * bits))
        ),
    )
    spread = F.col("uu") - F.col("u") * F.col("u")
    slope = F.when(spread > 1e-9, (F.col("ub") - F.col("u") * F.col("b")) / spread).otherwise(0.0)
    sums = sums.withColumn("slope", slope).withColumn("usual_lettered_entropy", F.col("b") - F.col("slope") * F.col("u"))
    return sums.select("kind", "key", "n", "slope", *(f"usual_{m}" for m in MEASURES))


def _off(measure: str, band: str = "") -> Column:
    """Distance of a text from the usual value, shrunk for short texts."""
    usual = F.col(f"{band}usual_{measure}")
    if measure == "lettered_entropy":
        usual = (usual + F.col(f"{band}slope") / _length()) / _length()
    return (F.col(measure) - usual) / F.sqrt(1 + F.lit(float(SHORT)) / F.greatest(F.col("n_lettered"), F.lit(1)))


def _bands(good: DataFrame, lang: str) -> DataFrame:
    """kind (lang or script), key, what is usual, and the quartiles of the distances from it."""
    names = {"lang": F.col(lang), "script": F.col("script")}
    keys = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in names.items())))
    columns = ["n_lettered", *MEASURES]
    groups = good.select(keys.alias("group"), *columns).select("group.*", *columns).filter("key is not null")
    usual = stored(_usual(groups).filter(F.col("n") >= LEAST_GROUP), "quality-usual")
    quartiles = [F.percentile_approx(_off(m), [0.25, 0.75], 1000).alias(f"b_{m}") for m in MEASURES]
    ranges = groups.join(usual, ["kind", "key"]).groupBy("kind", "key").agg(*quartiles)
    return stored(ranges.join(usual, ["kind", "key"]), "quality-bands")


def judged(metrics: DataFrame, lang: str = "lang", fence: dict[str, tuple[float, float]] = FENCE) -> DataFrame:
    """Adds base_failed and kept. Reads ``metrics`` several times, so it should be a stored table."""
    bands = _bands(metrics.filter(~base_failed()), lang)
    met = metrics
    for kind, key in (("lang", F.col(lang)), ("script", F.col("script"))):
        own = bands.filter(F.col("kind") == kind).select(F.struct("*").alias(f"{kind}_band"))
        met = met.join(own, key == F.col(f"{kind}_band.key"), "left")
    met = met.withColumn("_band", F.coalesce("lang_band", "script_band"))
    inside = F.lit(True)
    for m in MEASURES:
        low, high = F.get(F.col(f"_band.b_{m}"), F.lit(0)), F.get(F.col(f"_band.b_{m}"), F.lit(1))
        least = F.lit(LEAST_SPREAD[m]) * (F.col(f"_band.usual_{m}") if m == "lettered_chars" else 1)
        spread = F.greatest(high - low, least)
        below, above = fence[m]
        inside = inside & F.coalesce(_off(m, "_band.").between(low - below * spread, high + above * spread), F.lit(True))
    judgement = {"base_failed": base_failed(), "kept": ~base_failed() & inside}
    return met.withColumns(judgement).drop("lang_band", "script_band", "_band")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is to keep them."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own)), F.col("lang").alias("_lang"), F.col("text").alias("_text")
    )
    table = stored(measured(rows, [*own, "_lang"]), "quality-rows")
    kept = judged(table, "_lang").filter("kept")
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, own)))


def op2_fertility(spark, folder: str) -> DataFrame:
    rows = documents(spark, folder).select("doc_id", "lang", F.col("text").alias("_text"))
    table = stored(measured(rows, ["doc_id", "lang"]), "quality")
    return judged(table).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "chars_per_token", "byte_share", "entropy",
    )

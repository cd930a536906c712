"""A small table with every awkward row, and the texts of the small test tables."""

import random

from pyspark.sql import functions as F

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "size int, bucket string, _text string, fp string, whole string, c0 string, shard string, row string, kept string"
)
PASSAGE = " ".join(f"passage{i} of a shared text" for i in range(30))


def awkward_rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "délta", "épsilon", "zeta", "the", "of", "and", "词语", "omega"]

    def text(n):
        out = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
        return out.replace("7 ", "7\n")

    long = text(30_000)
    same = "One Line that repeats itself\nshort\n\n  ONE line that repeats itself \t\nlast words of this text"
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n \x0b\f\r ", "de", "b"), (4, same, "en", None),
        (5, same, None, "b"), (5, same, None, "b"), (6, long, "fr", "c"), (7, long + " tail", "fr", "c"),
        (None, text(40), "en", "a"), (None, None, None, None), (None, text(25), "xx", "a"),
        (8, "<|endoftext|> in a text  with odd　spaces  and   runs", "en", "d"), (9, "word " * 400, "en", "d"),
        (-3, "12345 678 --- ###", "en", "a"), (10, PASSAGE, "en", "b"), (11, text(60) + "\n" + PASSAGE + "\n" + text(9), "en", "c"),
    ]
    rows += [(20 + i, text(20 + 7 * i), ["en", "fr"][i % 2], "abc"[i % 3]) for i in range(40)]
    rows += [(70 + i, text(80), "en", "a") for i in range(5)]
    return rows


def awkward(spark):
    rows = [(*r, len(r[1] or ""), 1, "x", "y", "z", "w", None, "s", "r", "k") for r in awkward_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "text")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def small(spark, folder="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{folder}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def written(spark, df, tmp_path):
    """A folder with ``df`` as its documents, for registered queries."""
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def words(text):
    return [w for w in _split(text or "") if w]


def _split(text):
    for c in "\t\n\x0b\f\r":
        text = text.replace(c, " ")
    return text.split(" ")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


__all__ = ["F", "awkward", "awkward_rows", "empty", "lower", "small", "texts", "words", "written"]

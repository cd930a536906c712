"""Quality scores of documents by a Gaussian kernel over text statistics.

Every whole text becomes a short vector of statistics (``STATISTICS``), standardised by the training
rows and clipped. Random Fourier features, cosines of seeded random projections, approximate the
Gaussian kernel between such vectors, so that ridge regression on them is kernel regression whose
cost does not grow with the square of the rows: every task sums its rows' normal equations, the sums
are added by Spark, and one system of ``FEATURES`` unknowns is solved. The raw score is then
calibrated by isotonic regression on rows that the ridge did not see: labels are summed per fine
bin of the raw score, neighbouring bins that fall are pooled, and scores between pools interpolate.

All labelled rows of the training part count, whatever their number; what is sent between tasks and
to the driver depends on ``FEATURES``, ``FIT_TASKS`` and ``BINS`` alone.

Defined results: a null text counts as empty, and empty texts have the statistics zero and a score
like any other; a row without a quality is no training row; of several labels of an id the mean
counts, and every row of that id has it; a null id has no label and counts as the text 'null' for the
split; with no training row every score is 0.5; with no row to calibrate on, the raw score is cut to
0..1; equal texts get equal scores; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import crc_remainder, documents, stored
from tallywatch.llm.fertility import repeated_words
from tallywatch.llm.pieces import flat, portions, word_codes, words_of

STATISTICS = (
    "log_words", "log_word_chars", "word_chars_spread", "log_longest_word", "letters", "upper", "digits", "punctuation",
    "symbols", "odd_signs", "other", "space", "words_with_sign_end", "words_without_letter", "one_char_words", "distinct_words",
    "top_word", "repeated_words", "repeated_lines", "log_line_words", "byte_entropy", "word_entropy",
)
FEATURES = 384
WIDTH = 1.0  # of the kernel, times the square root of the number of statistics
RIDGE = 1e-3  # times the number of training rows
CLIP = 4.0
SEED = 42
FIT_TASKS = 64
CHUNKS = 16
BINS = 4096
CALIBRATION = 4  # every so many-th labelled document is kept for calibration
KEEP_FROM = 0.7
LOWER, UPPER, DIGIT, PUNCTUATION, SYMBOL, BLANK, OTHER = range(7)
ODD = "#*$%&|<>!^~=+_@\\/{}[]"


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of every code point, and whether it is one of ``ODD``."""
    of = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Cc": BLANK}
    first = {"L": LOWER, "M": LOWER, "N": OTHER, "P": PUNCTUATION, "S": SYMBOL, "Z": BLANK, "C": OTHER}
    kinds = (unicodedata.category(chr(c)) for c in range(0x110000))
    table = np.fromiter((of.get(k, first[k[0]]) for k in kinds), np.uint8, 0x110000)
    odd = np.zeros(0x110000, bool)
    odd[[ord(c) for c in ODD]] = True
    return table, odd


def _entropy(counts: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Bits per item of each text, from the counts of its distinct items."""
    total = np.bincount(owner, counts, texts)
    share = counts / np.maximum(total, 1)[owner]
    return np.bincount(owner, -share * np.log2(np.maximum(share, 1e-300)), texts)


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that repeat an earlier one."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines), len(lines) - len(set(lines))


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of ``STATISTICS`` per text."""
    n = len(texts)
    data, bounds = flat(texts)
    starts, ends, owner, words = words_of(data, bounds)
    codes, distinct = word_codes(data, starts, ends)
    raw = np.frombuffer(data, np.uint8)

    decoded = [t.decode("utf-8", "replace") for t in texts]
    chars = np.array([len(t) for t in decoded], np.int64)
    points = np.frombuffer("".join(decoded).encode("utf-32-le", "surrogatepass"), np.uint32)
    of_point = np.repeat(np.arange(n), chars)
    table, odd = _classes()
    kinds = np.bincount(of_point * 7 + table[points], minlength=7 * n).reshape(n, 7).astype(float)
    odds = np.bincount(of_point[odd[points]], minlength=n)

    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    length = (at[ends] - at[starts]).astype(float)
    sign = np.zeros(256, bool)
    sign[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
    letter = np.zeros(256, bool)
    letter[[c for c in range(256) if c >= 128 or chr(c).isalpha()]] = True
    letters = np.concatenate([[0], np.cumsum(letter[raw])])
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)

    pairs, times = np.unique(owner * max(len(distinct), 1) + codes, return_counts=True)
    of_pair = pairs // max(len(distinct), 1)
    top = np.zeros(n)
    np.maximum.at(top, of_pair, times)
    bytes_of = np.repeat(np.arange(n), np.diff(bounds))
    histogram = np.bincount(bytes_of * 256 + raw, minlength=256 * n)
    some = np.flatnonzero(histogram)
    lines, again = np.array([_lines(t) for t in texts], float).reshape(n, 2).T

    count = np.maximum(words, 1)
    blank = kinds[:, BLANK]
    solid = np.maximum(chars - blank, 1)
    per_word = lambda x: np.bincount(owner, x, n) / count
    mean = per_word(length)
    spread = np.sqrt(np.maximum(per_word(length**2) - mean**2, 0))
    alphabetic = kinds[:, LOWER] + kinds[:, UPPER]
    columns = [
        np.log1p(words), np.log1p(mean), np.log1p(spread), np.log1p(longest), alphabetic / solid,
        kinds[:, UPPER] / np.maximum(alphabetic, 1), kinds[:, DIGIT] / solid, kinds[:, PUNCTUATION] / solid,
        kinds[:, SYMBOL] / solid, odds / solid, kinds[:, OTHER] / solid, blank / np.maximum(chars, 1),
        per_word(sign[raw[ends - 1]].astype(float)), per_word((letters[ends] == letters[starts]).astype(float)),
        per_word((length == 1).astype(float)), np.bincount(of_pair, minlength=n) / count, top / count,
        repeated_words(codes, owner, n) / count, again / np.maximum(lines, 1), np.log1p(words / np.maximum(lines, 1)),
        _entropy(histogram[some].astype(float), some // 256, n),
        _entropy(times.astype(float), of_pair, n) / np.log2(np.maximum(words, 2)),
    ]
    return np.column_stack(columns)


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the array ``x`` of statistics of every row's whole text."""
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("text")
            texts = [t.as_py() for t in sizes]
            for low, high in portions(texts):
                found = statistics(texts[low:high])
                kept = [batch.column(c).slice(low, high - low) for c in keep]
                x = pa.array(list(found), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*kept, x], names=[*keep, "x"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(task, f"{schema}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


@dataclass(frozen=True)
class Kernel:
    """Standardisation and random features: bounded by ``FEATURES``, so tasks carry it along."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @staticmethod
    def drawn(mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int) -> Kernel:
        rng = np.random.default_rng(seed)
        directions = rng.standard_normal((len(mean), features)) / (width * math.sqrt(len(mean)))
        return Kernel(mean, scale, directions, rng.uniform(0, 2 * np.pi, features))

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random features of each row and a one for the intercept."""
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.column_stack([waves, np.ones(len(x))])


@dataclass(frozen=True)
class Model:
    kernel: Kernel
    weights: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    values: np.ndarray  # calibrated scores there, not falling

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        found = np.interp(raw, self.knots, self.values) if len(self.knots) else raw
        return np.clip(found, 0.0, 1.0)


def _normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums over all rows (x, label): features by features, features by label, and the number of rows."""
    size = len(kernel.phases) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            z = kernel.features(_matrix(batch.column("x")))
            total += z.T @ np.column_stack([z, labels])
        parts = np.array_split(total, CHUNKS)
        chunks = pa.array([p.tobytes() for p in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), chunks], names=["chunk", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in table.column("sums"))
        return pa.table({"chunk": table.column("chunk")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, sums binary"
    parts = rows.select("x", "label").repartition(FIT_TASKS).mapInArrow(sums, schema)
    rows_of = parts.groupBy("chunk").applyInArrow(added, schema).collect()  # CHUNKS rows
    total = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(rows_of, key=lambda r: r["chunk"])])
    total = total.reshape(size, size + 1)
    return total[:, :-1], total[:, -1], total[-1, -2]


def pooled(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: mean score and mean label of every pool;
    ``scores`` ascend."""
    pools: list[list[float]] = []  # weight, weighted score, weighted label
    for s, y, w in zip(scores, labels, weights):
        pools.append([w, w * s, w * y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    table = np.array(pools, float).reshape(-1, 3)
    return table[:, 1] / table[:, 0], table[:, 2] / table[:, 0]


def _raw_scores(rows: DataFrame, model: Model) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("label")], names=["raw", "label"])

    return rows.select("x", "label").mapInArrow(task, "raw double, label double")


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model | None:
    """The model from rows with x and label (0 to 1); equal statistics go to one side of the calibration split."""
    rows = stored(
        rows.select("x", "label", (F.pmod(F.xxhash64(F.lit(seed), "x"), F.lit(CALIBRATION)) == 0).alias("aside")),
        "kernelquality-rows",
    )
    learnt = rows.filter(~F.col("aside"))
    moments = [f(F.element_at("x", i + 1)).alias(f"{f.__name__}{i}") for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    found = learnt.agg(F.count(F.lit(1)).alias("n"), *moments).first()
    if not found["n"]:
        return None
    mean, scale = (np.array([found[f"{f}{i}"] for i in range(len(STATISTICS))], float) for f in ("avg", "stddev_pop"))
    kernel = Kernel.drawn(mean, np.where(scale > 1e-9, scale, 1.0), features, width, seed)
    square, right, n = _normal_equations(learnt, kernel)
    penalty = np.full(features + 1, ridge * n)
    penalty[-1] = 1e-9 * n  # the intercept is free
    weights = np.linalg.solve(square + np.diag(penalty), right)
    model = Model(kernel, weights, np.empty(0), np.empty(0))

    place = F.floor(F.least(F.greatest(F.col("raw"), F.lit(-1.0)), F.lit(2.0)) * (BINS // 3))
    binned = _raw_scores(rows.filter("aside"), model).groupBy(place.alias("bin")).agg(
        F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count(F.lit(1)).alias("n")
    )
    bins = sorted(tuple(r)[1:] for r in binned.collect())  # BINS rows at most
    if not bins:
        return model
    knots, values = pooled(*np.array(bins, float).T)
    return Model(kernel, weights, knots, values)


def score(rows: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """``keep`` and score of rows with x."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(_matrix(batch.column("x"))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], names=[*keep, "score"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "x").mapInArrow(task, f"{schema}, score double")


def scored(docs: DataFrame, labels: DataFrame, held: Column) -> DataFrame:
    """doc_id, held_out and score of every document; learns from the labels of rows that are not ``held``."""
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    rows = stored(with_statistics(rows, "doc_id", "held_out"), "kernelquality-statistics")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.avg((F.col("quality") == 1).cast("double")).alias("label"))
    model = fit(rows.filter(~F.col("held_out")).join(known, "doc_id"))
    return score(rows, model, "doc_id", "held_out")


def op13_kernel_quality(spark, folder: str) -> DataFrame:
    found = scored(documents(spark, folder), documents(spark, folder, "labels"), crc_remainder(F.col("doc_id"), 4) == 2)
    return found.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))

"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the letters of its words: n-grams of up to ``ORDER`` characters, the
longest by their counts and the shorter ones by how many characters they continue, each with an
absolute discount and interpolated with the next shorter one. The n-grams are kept as sorted arrays
of 64-bit hashes with one column per language, so one search serves all languages. A text gets the
language with the lowest cross-entropy per character; it is also rejected when that entropy lies
beyond what calibration documents of the language, held out of the counts, show at its length.

The models are fitted on a bounded sample of labelled rows: at most about ``MOST_ROWS`` documents
per language, drawn by a hash of the row, whole texts. Where these have more than ``MOST_GRAMS``
distinct n-grams, every language is bounded by the same lower number of documents, one at least;
all n-grams of the sample count. A language with too few documents for calibration is fitted on all
of them and not rejected. Every document is predicted from its whole text alone.

Defined results: a null text, or one without a letter, gets ``und`` and score 0, and so do all texts
where there is nothing to learn from; ties go to the language first by code points; equal texts get
equal predictions; a null id counts as the text 'null' for the split; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import bounded, crc_remainder, documents, small_batches, stored
from tallywatch.llm.pieces import flat, portions, word_codes, words_of

ORDER = 5
MOST_ROWS = 4000
MOST_GRAMS = 2_000_000
MOST_LANGUAGES = 1000
MOST_WORDS = 200_000
CALIBRATION = 4  # every so many-th document of the sample
LEAST_ASIDE = 10  # documents for the calibration of a language, with others to learn from
QUANTILE = 0.995
BEGIN, END = 2, 3  # control characters, which are no letters
NOT_LEARNED = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the letters, lower-cased, of all words one after the other; letters per word."""
    text = b"\n".join(words).decode("utf-8", "replace").lower()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    line_end = points == 10
    keep = _letters()[points]
    owner = np.cumsum(line_end)
    return points[keep], np.bincount(owner[keep], minlength=len(words))


def framed(points: np.ndarray, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with ``order - 1`` begin marks and an end mark; the places to predict, and the word of each.
    Words without a letter are left out."""
    some = np.flatnonzero(lengths)
    own = lengths[some] + order
    ends = np.cumsum(own)
    out = np.full(int(own.sum()), BEGIN, np.uint32)
    out[ends - 1] = END
    predicted = np.arange(len(out)) - np.repeat(ends - own, own) >= order - 1
    inner = predicted.copy()
    inner[ends - 1] = False
    out[inner] = points
    places = np.flatnonzero(predicted)
    return out, places, np.repeat(some, lengths[some] + 1)


def gram_hashes(points: np.ndarray, places: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1..order characters that end at each place."""

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    out = [mix(points[places].astype(np.uint64))]
    for back in range(1, order):
        out.append(mix(out[-1] * np.uint64(0xD1342543DE82EF95) + mix(points[places - back].astype(np.uint64))))
    return out


class Models:
    """Sorted hashes per order; per hash and language the probability (0: not seen), and per hash
    of a context what it leaves to the shorter context (1: not seen)."""

    def __init__(self, langs: list[str], grams: pd.DataFrame, order: int = ORDER):
        """``grams`` has lang (its number), gram (``order`` characters) and n."""
        self.langs, self.order = langs, order
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        lang, counts = grams["lang"].to_numpy(np.int64), grams["n"].to_numpy(np.float64)
        chars = np.frombuffer("".join(grams["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, order)
        levels = []  # (characters, lang, count) from the longest n-grams to single characters
        for width in range(order, 0, -1):
            levels.append((chars, lang, counts))
            if width > 1:
                # A shorter n-gram counts the characters seen before it.
                keys = np.column_stack([lang, chars[:, 1:]])
                distinct, times = np.unique(keys, axis=0, return_counts=True)
                lang, chars, counts = distinct[:, 0], distinct[:, 1:].astype(np.uint32), times.astype(np.float64)
        self.alphabet = np.bincount(levels[-1][1], minlength=len(langs)) + 1.0  # and one unknown character
        for chars, lang, counts in reversed(levels):
            self._add(chars, lang, counts)

    def _add(self, chars: np.ndarray, lang: np.ndarray, counts: np.ndarray) -> None:
        width, n = chars.shape[1], len(self.langs)
        once, twice = (np.bincount(lang[counts == r], minlength=n) for r in (1, 2))
        with np.errstate(invalid="ignore", divide="ignore"):
            discount = np.where((once > 0) & (twice > 0), once / (once + 2 * twice), 0.5)
        rows = np.ascontiguousarray(chars)
        at = np.arange(len(rows)) * width + width - 1
        hashes = gram_hashes(rows.ravel(), at, width)
        own = hashes[-1]
        if width > 1:
            contexts = gram_hashes(rows.ravel(), at - 1, width - 1)
            context = contexts[-1]
            shorter = self._up_to(hashes[:-1], contexts[:-1])[np.arange(len(rows)), lang]
        else:
            context = np.zeros(len(rows), np.uint64)
            shorter = 1.0 / self.alphabet[lang]
        keys, inverse = np.unique(context, return_inverse=True)
        cell = inverse * n + lang
        total = np.bincount(cell, weights=counts, minlength=len(keys) * n)
        kinds = np.bincount(cell, minlength=len(keys) * n)
        left = np.where(total > 0, discount[np.arange(len(total)) % n] * kinds / np.maximum(total, 1), 1.0)
        self.contexts.append((keys, left.reshape(-1, n).astype(np.float32)))
        chance = (counts - discount[lang]) / total[cell] + left[cell] * shorter
        grams, inverse = np.unique(own, return_inverse=True)
        table = np.zeros((len(grams), n), np.float32)
        table[inverse, lang] = chance
        self.tables.append((grams, table))

    @staticmethod
    def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)

    def _up_to(self, hashes: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Probabilities of the last characters by language, from contexts of 0, 1, ... characters."""
        chance = np.broadcast_to((1.0 / self.alphabet).astype(np.float32), (len(hashes[0]), len(self.langs)))
        contexts = [np.zeros(len(hashes[0]), np.uint64), *contexts]
        for (grams, table), (keys, left), own, context in zip(self.tables, self.contexts, hashes, contexts):
            at, hit = self._found(keys, context)
            chance = np.where(hit[:, None], left[at], 1.0) * chance
            at, hit = self._found(grams, own)
            seen = np.where(hit[:, None], table[at], 0.0)
            chance = np.where(seen > 0, seen, chance)
        return chance

    def log2(self, points: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log2 probability of the character at each place, by language."""
        longest = gram_hashes(points, places, self.order)[-1]
        # The longest n-gram decides: each distinct one is looked up once.
        _, first, inverse = np.unique(longest, return_index=True, return_inverse=True)
        places = places[first]
        contexts = gram_hashes(points, places - 1, self.order - 1)
        return np.log2(self._up_to(gram_hashes(points, places, self.order), contexts))[inverse]

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the log2 probabilities by word and language; characters predicted per word."""
        points, lengths = letter_words(words)
        total = np.zeros((len(words), len(self.langs)))
        if len(points):
            text, places, owner = framed(points, lengths, self.order)
            each = self.log2(text, places)
            for k in range(len(self.langs)):
                total[:, k] = np.bincount(owner, weights=each[:, k], minlength=len(words))
        return total, np.where(lengths > 0, lengths + 1, 0)

    def entropies(self, texts: list[bytes], known: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of every text by language; characters predicted per text.
        ``known`` keeps words from one call to the next."""
        data, bounds = flat(texts)
        starts, ends, owner, _ = words_of(data, bounds)
        codes, distinct = word_codes(data, starts, ends)
        total, size = (known or Words(self)).of_words(distinct.to_pylist())
        n = np.bincount(owner, weights=size[codes], minlength=len(texts))
        out = np.empty((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = -np.bincount(owner, weights=total[codes, k], minlength=len(texts)) / np.maximum(n, 1)
        return out, n


class Words:
    """The words a task has met lately, with their probabilities; at most about ``most`` of them."""

    def __init__(self, models: Models, most: int = MOST_WORDS):
        self.models, self.most = models, most
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.total, self.size = np.zeros((0, len(self.models.langs))), np.zeros(0, np.int64)

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > self.most:
            self.forget()
        new = [w for w in words if w not in self.place]
        if new:
            total, size = self.models.of_words(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.total, self.size = np.concatenate([self.total, total]), np.concatenate([self.size, size])
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return self.total[at], self.size[at]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def language_words(rows: DataFrame) -> DataFrame:
    """lang, word (its lower-cased letters) and n, from rows with lang and text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), _texts(batch)
            for low, high in portions(texts):
                data, bounds = flat(texts[low:high])
                starts, ends, owner, _ = words_of(data, bounds)
                codes, distinct = word_codes(data, starts, ends)
                names = sorted(set(langs[low:high]))
                number = np.array([names.index(x) for x in langs[low:high]])
                keys, counts = np.unique(number[owner] * max(len(distinct), 1) + codes, return_counts=True)
                points, lengths = letter_words(distinct.to_pylist())
                text = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                of_word = keys % max(len(distinct), 1)
                some = np.flatnonzero(lengths[of_word])
                yield pa.record_batch(
                    {
                        "lang": pa.array([names[i] for i in keys[some] // max(len(distinct), 1)], pa.string()),
                        "word": pa.array([text[cuts[w] : cuts[w + 1]] for w in of_word[some]], pa.string()),
                        "n": pa.array(counts[some].astype(np.int64)),
                    }
                )

    return rows.mapInArrow(task, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, most_rows: int = MOST_ROWS, order: int = ORDER) -> tuple[Models, dict]:
    """The models, and per language the usual entropy and the reach of its deviations; from rows with
    doc_id, text and lang."""
    drawn, grams = _sample(labelled.filter(F.col("lang").isNotNull()), most_rows, order)
    table = pd.DataFrame([tuple(r) for r in grams.collect()], columns=["lang", "gram", "n"])
    langs = sorted(set(table["lang"]))
    table["lang"] = table["lang"].map({x: i for i, x in enumerate(langs)})
    if not langs:
        return None, {}
    models = Models(langs, table, order)

    def own_entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, known = {x: i for i, x in enumerate(langs)}, Words(models)
        for batch in batches:
            names, texts = batch.column("lang").to_pylist(), _texts(batch)
            for low, high in portions(texts):
                found, n = models.entropies(texts[low:high], known)
                some = [i for i in range(high - low) if n[i] and names[low + i] in column]
                yield pa.record_batch(
                    {
                        "lang": pa.array([names[low + i] for i in some], pa.string()),
                        "h": pa.array([float(found[i, column[names[low + i]]]) for i in some], pa.float64()),
                        "n": pa.array([float(n[i]) for i in some], pa.float64()),
                    }
                )

    aside = stored(drawn.filter("aside").mapInArrow(own_entropy, "lang string, h double, n double"), "langid-aside")
    usual = aside.groupBy("lang").agg(F.percentile_approx("h", 0.5).alias("mid"))
    off = aside.join(F.broadcast(usual), "lang").withColumn("off", (F.col("h") - F.col("mid")) * F.sqrt("n"))
    reach = off.groupBy("lang").agg(F.first("mid").alias("mid"), F.percentile_approx("off", QUANTILE, 1000).alias("reach"))
    return models, {r["lang"]: (r["mid"], r["reach"]) for r in bounded(reach, MOST_LANGUAGES, "languages")}


def _sample(known: DataFrame, most_rows: int, order: int) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (lang, text, and whether aside for calibration), and lang, gram and n of the others."""
    draw = F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id", "text"), F.lit(CALIBRATION)) == 0
    rows = known.select("lang", "text", draw.alias("draw"), part.alias("part"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("first"))
    sizes = bounded(sizes, MOST_LANGUAGES, "languages")
    most = min(most_rows, max((r["n"] for r in sizes), default=0))
    while True:
        # Every language keeps the document that is drawn first.
        rates = [(r["lang"], max(most / r["n"], r["first"])) for r in sizes]
        rates = known.sparkSession.createDataFrame(rates, "lang string, rate double")
        drawn = rows.join(F.broadcast(rates), "lang").filter(F.col("draw") <= F.col("rate"))
        drawn = stored(drawn.select("lang", "text", "draw", "part"), "langid-sample")
        enough = drawn.groupBy("lang").agg(
            ((F.count_if("part") >= LEAST_ASIDE) & (F.count_if(~F.col("part")) >= LEAST_ASIDE)).alias("enough")
        )
        rows = drawn  # what a lower number of documents is drawn from
        drawn = drawn.join(F.broadcast(enough), "lang").withColumn("aside", F.col("part") & F.col("enough"))
        grams = stored(_grams(drawn.filter(~F.col("aside")), order), "langid-grams")
        found = grams.count()
        if found <= MOST_GRAMS or most <= 1:
            return drawn, grams
        most = max(1, int(most * min(0.7, MOST_GRAMS / found)))


def _grams(rows: DataFrame, order: int) -> DataFrame:
    """lang, gram and n of every n-gram of ``order`` characters."""
    padded = F.concat(F.lit(chr(BEGIN) * (order - 1)), F.col("word"), F.lit(chr(END)))
    places = F.sequence(F.lit(1), F.char_length("word") + 1)
    return (
        language_words(rows)
        .select("lang", "n", F.explode(F.transform(places, lambda i: F.substr(padded, i, F.lit(order)))).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


def predict(docs: DataFrame, models: Models | None, calibration: dict, keep: list[str]) -> DataFrame:
    """``keep``, lang_pred, score, entropy and rejected of every row, from its text alone."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    schema += ", lang_pred string, score double, entropy double, rejected boolean"
    langs = models.langs if models else []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(models) if models else None
        for batch in batches:
            texts = _texts(batch)
            for low, high in portions(texts):
                names, scores, entropy, rejected = _decide(texts[low:high], known)
                columns = [batch.column(c).slice(low, high - low) for c in keep]
                columns += [pa.array(names, pa.string()), pa.array(scores), pa.array(entropy), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "entropy", "rejected"])

    def _decide(texts: list[bytes], known: Words | None):
        if not models:
            return [NOT_LEARNED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), [True] * len(texts)
        found, n = models.entropies(texts, known)
        best = found.argmin(axis=1)
        lowest = found.min(axis=1)
        share = 1 / np.exp2(lowest[:, None] - found).sum(axis=1)
        names = [langs[b] if k else NOT_LEARNED for b, k in zip(best, n)]
        mids = np.array([calibration.get(x, (np.inf, 0))[0] for x in langs])[best]
        reach = np.array([calibration.get(x, (np.inf, 0))[1] for x in langs])[best]
        rejected = (n == 0) | ((lowest - mids) * np.sqrt(n) > reach)
        return names, np.where(n > 0, share, 0.0), np.where(n > 0, lowest, 0.0), rejected.tolist()

    return rows.mapInArrow(task, schema)


def identify(docs: DataFrame, held: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy and rejected; learns from rows that are not ``held``."""
    rows = docs.select("doc_id", "lang", "text", held.alias("held_out"))
    models, calibration = fit(rows.filter(~F.col("held_out")).select("doc_id", "lang", "text"))
    return predict(rows.select("doc_id", "held_out", "text"), models, calibration, ["doc_id", "held_out"])


def op9_kneser_ney(spark, folder: str) -> DataFrame:
    return identify(documents(spark, folder), crc_remainder(F.col("doc_id"), 4) == 2)

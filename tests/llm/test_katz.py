import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallywatch.llm import katz
from tests.llm.cases import awkward, awkward_rows, empty, lower, small, texts, words, written


def held(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def tokens_of(text):
    return [*words(lower(text)), " end"]


class Brute:
    """The model by plain dictionaries."""

    def __init__(self, docs):
        self.words, self.pairs = Counter(), Counter()
        for i, t in docs:
            if not held(i):
                tokens = tokens_of(t)
                self.words.update(tokens)
                self.pairs.update(zip([" begin", *tokens], tokens))
        self.total = sum(self.words.values())
        self.d1, self.d2 = (katz.good_turing(self.levels(c)) for c in (self.words, self.pairs))
        lost = sum(c * (1 - self.d1[c]) for c in self.words.values() if c <= 5)
        self.scale = 1 if lost > 0 else self.total / (self.total + 1)
        self.unseen = lost / self.total if lost > 0 else 1 / (self.total + 1)
        self.after = defaultdict(dict)
        for (h, w), c in self.pairs.items():
            self.after[h][w] = c

    @staticmethod
    def levels(counts):
        by = Counter(counts.values())
        return [by[r] for r in range(1, 7)]

    def word(self, w):
        c = self.words[w]
        return self.scale * (self.d1[c] if c <= 5 else 1) * c / self.total if c else self.unseen

    def given(self, h, w):
        after = self.after.get(h)
        if not after:
            return self.word(w)
        n = sum(after.values())
        all_large = min(after.values()) > 5
        scale = n / (n + 1) if all_large else 1
        found = {x: scale * (self.d2[c] if c <= 5 else 1) * c / n for x, c in after.items()}
        if w in found:
            return found[w]
        return (1 - sum(found.values())) / (1 - sum(self.word(x) for x in after)) * self.word(w)

    def row(self, i, t):
        tokens = tokens_of(t)
        v = len(self.words)
        base = sum(math.log10((self.words[w] + 0.5) / (self.total + 0.5 * (v + 1))) for w in tokens)
        score = sum(math.log10(self.given(h, w)) for h, w in zip([" begin", *tokens], tokens))
        return i, held(i), len(tokens), sum(self.words[w] > 0 for w in tokens), self.total, base, score


def compare(df, docs):
    found = sorted((tuple(r) for r in df.collect()), key=repr)
    model = Brute(docs)
    expected = sorted((model.row(i, t) for i, t in docs), key=repr)
    assert len(found) == len(expected)
    # Equal ids with other texts may be sorted otherwise by rounding; compare on the exact columns first.
    key = lambda r: (repr(r[:5]), round(r[5], 4))
    for f, e in zip(sorted(found, key=key), sorted(expected, key=key)):
        assert f[:5] == e[:5]
        assert f[5] == pytest.approx(e[5], rel=1e-9, abs=1e-9) and f[6] == pytest.approx(e[6], rel=1e-9, abs=1e-9)


def test_query_on_the_small_table(spark, folder):
    compare(katz.op10_katz(spark, folder), texts(small(spark)))


def test_awkward_rows_and_many_chunks_and_parts(spark, tmp_path):
    docs = [(r[0], r[1]) for r in awkward_rows()] + [(2**60 + 1, "an id beyond doubles")]
    more = awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame(docs[-1:], "doc_id bigint, text string"))
    split = katz.crc_remainder(F.col("doc_id"), 5) == 1
    compare(katz.op10_katz(spark, written(spark, awkward(spark), tmp_path)), docs[:-1])
    compare(katz.score_documents(more.repartition(2), split, chunk_bytes=3000, entries=400), docs)


def test_bigrams_in_many_ranges_of_histories(spark):
    docs = texts_of_cases()
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    split = katz.crc_remainder(F.col("doc_id"), 5) == 1
    compare(katz.score_documents(rows, split, chunk_bytes=2000, entries=900, served=50), docs)


def test_every_history_sums_to_one():
    model = Brute(texts_of_cases())
    vocabulary = [*model.words, "never seen"]
    assert sum(model.word(w) for w in vocabulary) == pytest.approx(1)
    for h in [" begin", "the2", *list(model.after)[:40]]:
        assert sum(model.given(h, w) for w in vocabulary) == pytest.approx(1)


def texts_of_cases():
    return [(r[0], r[1]) for r in awkward_rows() if len(r[1] or "") < 5000]


def test_discounts():
    assert katz.good_turing([100, 40, 20, 12, 8, 5])[1:] == pytest.approx(
        [(x / r - 6 * 5 / 100) / (1 - 6 * 5 / 100) for r, x in zip(range(1, 6), [0.8, 1.5, 2.4, 10 / 3, 3.75])]
    )
    assert list(katz.good_turing([0] * 6)[1:]) == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]


def test_a_row_without_training_and_an_empty_table(spark, tmp_path):
    docs = awkward(spark).filter("doc_id = 9")
    row = katz.score_documents(docs, F.lit(True)).first()
    assert (row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (0, 0, 0.0, 0.0)
    assert katz.op10_katz(spark, written(spark, empty(spark), tmp_path)).collect() == []

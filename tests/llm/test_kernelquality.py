import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallywatch.llm import kernelquality as kq
from tests.llm.cases import awkward, awkward_rows, empty, small, texts, words, written


def entropy(items):
    counts, n = Counter(items), len(items)
    return -sum(c / n * math.log2(c / n) for c in counts.values())


def plain(text):
    """Some statistics again, word by word."""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    solid = [c for c in text if kq._classes()[0][ord(c)] != kq.BLANK]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] >= 2 for k in range(5)}
    n = max(len(w), 1)
    return {
        "log_words": math.log1p(len(w)),
        "log_word_chars": math.log1p(sum(map(len, w)) / n),
        "log_longest_word": math.log1p(max(map(len, w), default=0)),
        "odd_signs": sum(c in kq.ODD for c in text) / max(len(solid), 1),
        "letters": sum(c.isalpha() for c in text if not 0x300 <= ord(c) < 0x370) / max(len(solid), 1),
        "words_with_sign_end": sum(x[-1].isascii() and not x[-1].isalnum() for x in w) / n,
        "one_char_words": sum(len(x) == 1 for x in w) / n,
        "distinct_words": len(set(w)) / n,
        "top_word": max(Counter(w).values(), default=0) / n,
        "repeated_words": len(covered) / n,
        "repeated_lines": (len(lines) - len(set(lines))) / max(len(lines), 1),
        "byte_entropy": entropy(text.encode()) if text else 0.0,
        "word_entropy": entropy(w) / math.log2(max(len(w), 2)) if w else 0.0,
    }


def test_statistics_match_brute_force(spark):
    some = [t or "" for _, t in texts(small(spark))[:60]] + [r[1] or "" for r in awkward_rows()] + ["ab #$ AB!", "日本 x"]
    found = kq.statistics([t.encode() for t in some])
    assert np.isfinite(found).all() and not kq.statistics([b""]).any()
    for row, text in zip(found, some):
        for name, value in plain(text).items():
            assert math.isclose(row[kq.STATISTICS.index(name)], value, abs_tol=1e-9), (name, text[:50])
    alone = np.vstack([kq.statistics([t.encode()]) for t in some])
    assert np.allclose(alone, found, atol=1e-12)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 22))
    kernel = kq.Kernel.drawn(np.zeros(22), np.ones(22), 20_000, 1.0, 7)
    z = kernel.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 22))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_pools_match_the_min_max_formula():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = 30
        y, w, s = rng.integers(0, 4, n) / 3.0, rng.integers(1, 5, n).astype(float), np.sort(rng.random(n))
        mean = lambda a, b: (y[a:b] @ w[a:b]) / w[a:b].sum()
        exact = [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
        knots, values = kq.pooled(s, y, w)
        assert (np.diff(values) > -1e-12).all() and (np.diff(knots) > 0).all()
        assert np.allclose(sorted(set(np.round(exact, 9))), sorted(set(np.round(values, 9))))


def test_partition_sums_solve_the_same_ridge(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((500, len(kq.STATISTICS)))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, label double").repartition(7)
    kernel = kq.Kernel.drawn(x.mean(axis=0), x.std(axis=0), 50, 1.0, 1)
    square, right, n = kq._normal_equations(rows, kernel)
    z = kernel.features(x)
    assert n == 500 and np.allclose(square, z.T @ z) and np.allclose(right, z.T @ y)


def held(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = kq.op13_kernel_quality(spark, folder).collect()
    assert len(found) == small(spark, folder).count()
    kept = defaultdict(list)
    for r in found:
        assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        if r["held_out"] and r["doc_id"] in truth:
            kept[truth[r["doc_id"]]].append(r["predicted"])
    assert np.mean(kept[1]) > 0.97 and np.mean(kept[0]) < 0.05


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = small(spark), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    is_held = kq.crc_remainder(F.col("doc_id"), 4) == 2
    turned = labels.withColumn("quality", F.when(is_held, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("s"))
    rows = lambda d, q: sorted((r["doc_id"], round(r["score"], 9)) for r in kq.scored(d, q, is_held).collect())
    assert rows(docs, labels) == rows(other, turned)


def folder_of(spark, docs, labels, path):
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return written(spark, docs, path)


def test_awkward_rows(spark, tmp_path):
    labels = [(i, int(i % 3 > 0), 0) for i in range(-3, 60)] + [(5, 0, 1), (None, 1, 0), (7, None, 0), (999, 1, 0)]
    found = kq.op13_kernel_quality(spark, folder_of(spark, awkward(spark), labels, tmp_path)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in awkward_rows())
    scores = defaultdict(set)
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] in (0, 1)
        scores[r["doc_id"]].add(r["score"])
    assert len(scores[1]) == 1 and scores[1] == scores[2]  # a null and an empty text
    assert len(scores[5]) == 1


def test_without_labels_and_without_rows(spark, tmp_path):
    nothing = kq.op13_kernel_quality(spark, folder_of(spark, awkward(spark), [], tmp_path)).collect()
    assert {(r["score"], r["predicted"]) for r in nothing} == {(0.5, 0)}
    none = kq.op13_kernel_quality(spark, folder_of(spark, empty(spark), [(1, 1, 0)], tmp_path / "none"))
    assert none.collect() == [] and [t for _, t in none.dtypes] == ["bigint", "boolean", "double", "int"]

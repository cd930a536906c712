from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallywatch.llm.mixing import OP1_SQL, mix, mixed_documents, op1_mixing, route, water_level
from tests.compare import connect, differences
from tests.llm.cases import awkward, awkward_rows, empty, small, words, written


def test_water_level_reshares_the_excess():
    assert water_level([100, 100], [1, 1]) == [100, 100]
    assert water_level([10, 100, 100], [10, 1, 1]) == [30, 90, 90]
    assert water_level([0, 50], [5, 1]) == [0, 50]
    for sizes, weights in (([5, 7, 900, 3], [3, 2, 1, 3]), ([1, 1, 1000], [1, 2, 3])):
        got = water_level(sizes, weights)
        assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s for t, s in zip(got, sizes))


def test_route_matches_a_brute_force_minimum():
    capacities, members, quotas = [2, 3, 1], [[0], [0, 1], [1]], [5, 4]
    flow = route(capacities, members, quotas)
    assert [sum(f.get(s, 0) for f in flow) for s in range(2)] == quotas
    used = [sum(f.values()) for f in flow]

    def cost(total, cap):
        return sum(min(cap, max(0, total - k * cap)) * c for k, c in enumerate((1, 3, 5)))

    best = min(
        cost(a, 2) + cost(b + c, 3) + cost(d, 1)
        for a in range(7) for b in range(10) for c in range(10) for d in range(4)
        if a + b == 5 and c + d == 4 and b + c <= 9
    )
    assert sum(cost(u, c) for u, c in zip(used, capacities)) == best


def test_route_takes_words_back_for_a_source_with_no_other_way():
    # The first pattern fills source 0; the second can only go there, so the first moves to source 1.
    flow = route([4, 4], [[0, 1], [0]], [4, 4], (1,))
    assert flow[1] == {0: 4} and flow[0].get(1) == 4


def check(docs, result):
    sizes = {i: len(words(t)) for i, t in docs}
    by_source = defaultdict(list)
    for r in result:
        assert r["size"] in (sizes[r["doc_id"]],) and r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        by_source[r["source_size"], r["target"]].append((r["size"], r["copies"]))
    for (size, target), rows in by_source.items():
        assert target <= 3 * size
        near(target, rows)


def near(target, rows):
    """What is missing is less than the smallest document that the last pass did not take."""
    total = sum(n for n, _ in rows)
    untaken = [n for n, c in rows if n and c == int(target) // max(1, total)] or [max(n for n, _ in rows)]
    assert abs(sum(n * c for n, c in rows) - target) < max(1, min(untaken)) + 1


def test_query_on_the_small_table(spark, folder):
    result = op1_mixing(spark, folder).collect()
    docs = [(r["doc_id"], r["text"]) for r in small(spark).collect()]
    assert Counter(r["doc_id"] for r in result) == Counter(i for i, _ in docs)
    check(docs, result)
    assert sum(r["target"] for r in {r["source_size"]: r for r in result}.values()) > 0
    assert differences(op1_mixing(spark, folder), connect(folder), OP1_SQL) == []
    again = op1_mixing(spark, folder).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, result))


def test_a_larger_table_comes_within_a_document_of_its_targets(spark):
    folder = "/root/testdata/sf0.01"
    check([(r["doc_id"], r["text"]) for r in small(spark, folder).collect()], op1_mixing(spark, folder).collect())


def test_awkward_rows(spark, tmp_path):
    folder = written(spark, awkward(spark), tmp_path)
    result = op1_mixing(spark, folder).collect()
    assert len(result) == len(awkward_rows())
    assert sum(r["size"] for r in result) == sum(len(words(r[1])) for r in awkward_rows())
    assert all(r["taken"] == 0 for r in result if r["size"] == 0)
    assert len({(r["source_size"], r["target"]) for r in result}) == 5  # a, b, c, d and null


def test_empty_table(spark, tmp_path):
    assert op1_mixing(spark, written(spark, empty(spark), tmp_path)).collect() == []


def test_overlapping_sources_share_documents(spark):
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"),
        F.lit("a b c d e f g h i j").alias("text"),
        F.when(F.col("id") < 100, F.array(F.lit("x")))
        .when(F.col("id") < 200, F.array(F.lit("x"), F.lit("y")))
        .otherwise(F.array(F.lit("y")))
        .alias("m"),
    )
    rows = mix(docs, F.col("m"), weights=(1, 1), keep=("doc_id",)).collect()
    # 2000 words belong to each source: together 4000 of target from 3000 words.
    assert sum(r["size"] * r["copies"] for r in rows) == 4000
    assert {r["copies"] for r in rows} == {1, 2}


def test_mixed_documents_keep_their_columns(spark):
    docs = awkward(spark)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.schema == docs.schema
    counts = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    plain = Counter((r[0], r[1]) for r in awkward_rows())
    assert all(n <= 3 * plain[k] for k, n in counts.items())


def test_the_last_pass_goes_on_after_a_document_that_does_not_fit(spark):
    # 4000 of the 6000 words of a are wanted, one document has 2000 of them; b is taken whole and more.
    sizes = [(i, 10, "a") for i in range(400)] + [(400, 2000, "a"), (401, 6000, "b")]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in sizes], "doc_id bigint, text string, s string")
    for seed in ("1", "2", "3"):
        rows = mix(docs, F.array("s"), weights=(1, 2), seed=seed, keep=("doc_id", "s")).collect()
        assert len(rows) == len(sizes)
        a = [r for r in rows if r["s"] == "a"]
        assert a[0]["targets"] == [4000.0] and {r["copies"] for r in a} == {0, 1}
        assert sum(r["size"] * r["copies"] for r in a) == 4000

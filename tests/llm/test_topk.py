import math
import random

from tallywatch.llm.topk import BLOCK, op3_topk


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i is None or i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(q, c)), j is None, j or 0, j) for j, c in good if j != i]
        out += [(i, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def run(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], "vec_id bigint, embedding array<float>, label int, weights string, score int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    return sorted((tuple(r) for r in op3_topk(spark, str(tmp_path)).collect()), key=repr)


def test_matches_brute_force_with_ties_and_bad_vectors(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.125, 0.0]) for _ in range(6)]) for i in range(3 * BLOCK)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)]  # one very common vector
    rows += [(500, None), (550, []), (600, [1.0, None]), (650, [float("nan")] * 6), (700, [float("inf")] * 6)]
    rows += [(750, [0.5, 0.25]), (None, [0.5] * 6), (801, [0.25] * 6), (801, [0.25] * 6), (850, [-0.5] * 6)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_several_shards_and_groups(spark, tmp_path, monkeypatch):
    import tallywatch.llm.topk as topk

    monkeypatch.setattr(topk, "SHARD_ROWS", 300)
    monkeypatch.setattr(topk, "QUERY_GROUP", 4)
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(1000)]
    rows = [(i, [float(__import__("struct").unpack("f", __import__("struct").pack("f", x))[0]) for x in v]) for i, v in rows]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_few_rows_and_none(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    assert run(spark, [(50, [0.5]), (51, [0.25])], tmp_path / "a") == [(50, 1, 51, 128 * 64)]
    assert run(spark, [], tmp_path / "b") == []


def test_large_components_are_exact(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, [float(rng.randrange(-9, 9)) for _ in range(4)]) for i in range(300)]
    rows += [(400, [2.0**23, 1.0, 0.0, -(2.0**24)]), (401, [2.0**20, 0.0, 0.0, 1.0]), (402, [0.0, -(2.0**40), 0.0, 0.0])]
    rows += [(450, [2.0**20, 0.0, 2.0**7, 0.0]), (451, [0.0, 0.0, 2.0**35, 0.5])]
    found = run(spark, rows, tmp_path)
    assert found == brute(rows) and max(r[3] for r in found) > 2**53

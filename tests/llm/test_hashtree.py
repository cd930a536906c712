import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallywatch.llm.hashtree import OP4_SQL, Leaf, even_tree, grown, op4_hash_tree, place, shard_documents
from tests.compare import connect, differences
from tests.llm.cases import awkward, awkward_rows, empty, texts, small, written


def check(docs, result):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in result) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs
    )
    slots, of_id = defaultdict(list), defaultdict(set)
    for r in result:
        slots[r["shard"]].append(r["slot"])
        of_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(places) == 1 for places in of_id.values())


def test_query_on_the_small_table(spark, folder):
    result = op4_hash_tree(spark, folder).collect()
    check(texts(small(spark)), result)
    assert any(r["grown_shard"] == 16 for r in result)
    assert differences(op4_hash_tree(spark, folder), connect(folder), OP4_SQL) == []


def descend(key, tree):
    """The draws of each level by hand: exponential, the smallest wins."""
    tree = [x for x in tree if x.weight > 0]
    for name, level in (("r{0.region}", lambda x: x.region), ("k{0.region}.{0.rack}", lambda x: x.rack), ("s{0.shard}", lambda x: x.shard)):
        nodes = defaultdict(list)
        for leaf in tree:
            nodes[level(leaf)].append(leaf)

        def drawn(leaves, name=name):
            digest = hashlib.md5(f"{key}/{name.format(leaves[0])}".encode()).hexdigest()
            return -math.log((int(digest[:13], 16) + 1) / 2**52) / sum(x.weight for x in leaves)

        tree = min((nodes[k] for k in sorted(nodes)), key=drawn)
    return tree[0].shard


def test_placement_matches_brute_force(spark):
    ids = [None, *range(-5, 400)]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    uneven = [Leaf(0, 0, 0, 1.0), Leaf(0, 0, 1, 3.5), Leaf(0, 1, 2, 0.0), Leaf(1, 0, 3, 2.0), Leaf(1, 1, 4, 0.5), Leaf(3, 0, 9, 1.0)]
    for tree in (even_tree(1), even_tree(16), grown(even_tree(16)), uneven, grown(uneven, 3)):
        found = docs.select("doc_id", place(F.col("doc_id"), tree).alias("s")).collect()
        assert {r["doc_id"]: r["s"] for r in found} == {i: descend("null" if i is None else i, tree) for i in ids}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    docs = spark.range(3000)
    trees = [grown(even_tree(founded), n - founded) for founded in (1, 16) for n in range(founded, 42)]
    found = docs.select(*(place(F.col("id"), t).alias(f"t{i}") for i, t in enumerate(trees))).collect()
    for i, (a, b) in enumerate(zip(trees, trees[1:])):
        if len(b) == len(a) + 1:
            moved = [r for r in found if r[i] != r[i + 1]]
            assert moved and all(r[i + 1] == len(a) for r in moved)
            assert abs(len(moved) / 3000 - 1 / len(b)) < 0.04


def test_founded_trees_of_any_size_grow_by_the_law(spark):
    pairs = [(even_tree(n), grown(even_tree(n))) for n in range(1, 41)]
    both = [(place(F.col("id"), a) == place(F.col("id"), b)) | (place(F.col("id"), b) == len(a)) for a, b in pairs]
    assert spark.range(1000).filter(~F.forall(F.array(*both), lambda x: x)).count() == 0


def test_shares_follow_weights_and_movement_is_confined(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "cast(null as string) as text")
    tree = [Leaf(0, 0, 0, 1.0), Leaf(0, 0, 1, 3.0), Leaf(0, 1, 2, 2.0), Leaf(1, 0, 3, 2.0), Leaf(1, 1, 4, 2.0)]
    heavier = [*tree[:2], Leaf(0, 1, 2, 4.0), *tree[3:]]
    rows = shard_documents(docs, tree, heavier).collect()
    share = Counter(r["shard"] for r in rows)
    assert all(abs(share[x.shard] / 20_000 - x.weight / 10) < 0.02 for x in tree)
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    # Only the path to the heavier shard gains, and nothing moves within what kept its weights.
    assert moved and all(r["grown_shard"] in (0, 1, 2) for r in moved)
    assert not any({r["shard"], r["grown_shard"]} <= {0, 1} for r in moved)
    assert not any(r["shard"] in (0, 1, 2) and r["grown_shard"] in (3, 4) for r in moved)


def test_awkward_rows(spark, tmp_path):
    result = op4_hash_tree(spark, written(spark, awkward(spark), tmp_path)).collect()
    check([(r[0], r[1]) for r in awkward_rows()], result)


def test_many_equal_rows(spark):
    docs = spark.range(200_000).selectExpr("7L as doc_id", "'same' as text")
    rows = shard_documents(docs, even_tree(16), grown(even_tree(16))).agg({"slot": "max", "*": "count"}).first()
    assert tuple(rows) == (199_999, 200_000) or tuple(rows) == (200_000, 199_999)


def test_empty_table(spark, tmp_path):
    assert op4_hash_tree(spark, written(spark, empty(spark), tmp_path)).collect() == []

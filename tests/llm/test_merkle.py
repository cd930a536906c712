import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallywatch.llm import merkle
from tests.compare import connect, differences
from tests.llm.cases import awkward, empty, lower, small, written

NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests):
    """The root, and per leaf the siblings of each level as (left, right)."""
    nodes, under = list(digests), [[i] for i in range(len(digests))]
    beside = [[] for _ in digests]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for i in under[a + k]:
                    beside[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h("".join(run)))
            held.append([i for part in under[a : a + 16] for i in part])
        nodes, under = up, held
    return nodes[0], beside


def brute(rows):
    of = defaultdict(list)
    for r in rows:
        of[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(of[s], key=lambda x: x[:3])]) for s in names}
    root, over = climb([trees[s][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for (_, _, own, r), beside in zip(sorted(of[s], key=lambda x: x[:3]), trees[s][1]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf((*r[:4], None if r[4] is None else lower(r[4]))) if tampered else own
            path = beside + over[k]
            for a, b in path:
                folded = h(a + folded + b)
            out[(r[0], own, trees[s][0], root, h("".join(a + b for a, b in path)), folded, folded == root)] += 1
    return out


def rows_of(docs):
    return [tuple(r) for r in docs.select(*NAMES).collect()]


def test_query_on_the_small_table(spark, folder):
    found = merkle.op12_merkle(spark, folder).collect()
    assert Counter(map(tuple, found)) == brute(rows_of(small(spark)))
    assert {r["verified"] for r in found} == {True, False}


def test_query_matches_sql(spark, folder):
    assert differences(merkle.op12_merkle(spark, folder), connect(folder), merkle.OP12_SQL) == []


def test_awkward_rows(spark, tmp_path):
    found = merkle.op12_merkle(spark, written(spark, awkward(spark), tmp_path)).collect()
    assert Counter(map(tuple, found)) == brute(rows_of(awkward(spark)))


def test_empty_table(spark, tmp_path):
    assert merkle.op12_merkle(spark, written(spark, empty(spark), tmp_path)).collect() == []


def test_many_blocks_many_sources_and_equal_rows(spark):
    """Trees of several rounds, sources of one row, and a tree over the sources of more than a block."""
    source = "if(id < 5000, 'big', if(id < 5257, 'block', if(id < 5300, null, concat('s', id))))"
    docs = spark.range(6000).selectExpr(
        "if(id < 700, 7L, id) as doc_id", f"{source} as source", "'en' as lang", "id % 3 as n_chars",
        "if(id < 600, 'Same', concat('Text ', id)) as text",
    )
    made = merkle.manifest(docs, F.col("doc_id") % 2 == 0, F.lit("other"))
    found = made.versions.select("leaf", "subroot", "root", "proof_sha256").collect()
    wanted = Counter()
    for key, n in brute(rows_of(docs)).items():
        wanted[key[1:5]] += n
    assert Counter(map(tuple, found)) == wanted and len(made.nodes) == 3 and len(made.tops) == 3


def test_versions_share_all_but_the_path():
    leaves = [h(str(i)) for i in range(200)]
    root = merkle.tree_of(leaves, 2)
    copied = merkle.with_leaf(root, 100, 2, h("new"))
    new = copied[-1]
    assert len(copied) == 3 and root.digest == merkle.tree_of(leaves, 2).digest != new.digest
    assert new.digest == merkle.tree_of([*leaves[:100], h("new"), *leaves[101:]], 2).digest
    assert [a is b for a, b in zip(root.children, new.children)] == [i != 6 for i in range(13)]
    assert [a is b for a, b in zip(root.children[6].children, new.children[6].children)] == [i != 4 for i in range(16)]


def test_version_equals_the_tree_of_the_changed_table(spark):
    docs = small(spark)
    made = merkle.manifest(docs, F.col("doc_id") == 17, F.lit("tampered"))
    version = made.versions.filter("tampered").collect()
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 17, F.lit("tampered")).otherwise(F.col("text")))
    again = merkle.manifest(changed).versions.filter("doc_id = 17").first()
    assert len(version) == 1 and version[0]["copied"][-1] == again["root"] != version[0]["root"]
    assert version[0]["copied"][0] == again["leaf"] and version[0]["proof_sha256"] == again["proof_sha256"]

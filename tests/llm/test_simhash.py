import random
from collections import defaultdict

import numpy as np
import xxhash

from tallywatch.llm.simhash import _links_of_group, components, op5_simhash, one_per_group, with_components
from tests.llm.cases import awkward, awkward_rows, empty, lower, small, texts, words, written


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, distance=4):
    """Component number of every value, by comparing all of them."""
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def brute(docs):
    prints = [fingerprint(t) for _, t in docs]
    least = defaultdict(list)
    for c, (i, _) in zip(classes(prints), docs):
        least[c].append(i)
    return sorted(
        (
            (i, f"{p:016x}", min((x for x in least[c] if x is not None), default=None))
            for c, p, (i, _) in zip(classes(prints), prints, docs)
        ),
        key=repr,
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_on_the_small_table(spark, folder):
    assert rows(op5_simhash(spark, folder)) == brute(texts(small(spark)))


def test_awkward_rows(spark, tmp_path):
    found = rows(op5_simhash(spark, written(spark, awkward(spark), tmp_path)))
    assert found == brute([(r[0], r[1]) for r in awkward_rows()])


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_chains_and_dense_groups_match_all_pairs(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = set()
    for b in base:
        for _ in range(150):
            x = b
            for _ in range(rng.choice([1, 2, 3, 5, 7])):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    chain = rng.getrandbits(64)
    for step in range(15):
        chain ^= 0b1111 << (4 * step)
        values.add(chain)
    values = sorted(values)
    df = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(values)], "doc_id bigint, fp bigint")
    found = {r["doc_id"]: r["component_id"] for r in with_components(df).collect()}
    by = defaultdict(list)
    for i, c in enumerate(classes(values)):
        by[c].append(i)
    assert found == {i: min(group) for group in by.values() for i in group}


def test_links_of_a_large_group_connect_what_all_pairs_connect():
    rng = random.Random(2)
    values = sorted({rng.getrandbits(10) << 20 | rng.getrandbits(9) for _ in range(600)})
    array = np.array(values, np.uint64)
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    edges = list(_links_of_group(array, 2))
    assert all((a ^ b).bit_count() <= 2 for a, b in edges) and len(edges) < 2 * len(values)
    for a, b in edges:
        parent[root(a)] = root(b)
    expected = classes(values, 2)
    pairs = {(e, root(v)) for e, v in zip(expected, values)}
    assert len(pairs) == len(set(expected)) == len({p[1] for p in pairs})


def test_components_of_a_long_path(spark):
    edges = spark.range(199).selectExpr("id + 1 as u", "id as v")
    assert {r["root"] for r in components(edges).collect()} == {0}


def test_one_row_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = one_per_group(docs)
    assert kept.schema == docs.schema
    expected = brute([(r[0], r[1]) for r in awkward_rows()])
    groups = {(r[2] if r[2] is not None else r[1]) for r in expected}
    assert kept.count() == len(groups)
    assert [r for r in kept.collect() if r["doc_id"] == 7] == []


def test_empty_table(spark, tmp_path):
    assert op5_simhash(spark, written(spark, empty(spark), tmp_path)).collect() == []

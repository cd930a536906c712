import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywatch.llm.repeats import op8_suffix_dedup, segments, without_repeats
from tallywatch.llm.suffixes import permuted_prefixes, suffix_array
from tests.llm.cases import awkward, awkward_rows, empty, small, texts, written


def brute(docs, length=200):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(d[a : a + length] for _, d in data for a in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for a in range(len(d) - length + 1):
            if seen[d[a : a + length]] > 1:
                gone[a : a + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_on_the_small_table(spark, folder):
    expected = brute(texts(small(spark)))
    assert sum(r[2] for r in expected) > 0
    assert rows(op8_suffix_dedup(spark, folder)) == expected


def hard_docs():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdef gh") for _ in range(150))
    shared = "".join(rng.choice("abcdef gh") for _ in range(420))

    def filler(n):
        return "".join(rng.choice("abcdefghij klmnop") for _ in range(n))

    docs = [(i, filler(230) + passage + filler(170)) for i in range(60)]  # shorter than a window
    docs += [(100 + i, filler(50 + i) + shared[i : 260 + 3 * i] + filler(90)) for i in range(40)]
    docs += [(200, "a" * 9000), (201, "ab" * 3000 + "c"), (202, "xyz" * 40), (203, "é" * 300), (204, filler(199)), (205, "b" * 200)]
    docs += [(206, "b" * 200), (207, shared), (207, shared), (208, ("0123456789" * 25)[:207]), (2**60 + 1, filler(20)), (None, shared + filler(10))]
    return docs


def test_awkward_rows(spark, tmp_path):
    docs = [(r[0], r[1]) for r in awkward_rows() if len(r[1] or "") < 100_000] + hard_docs()
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, chunk int")
    assert rows(op8_suffix_dedup(spark, written(spark, frame, tmp_path))) == brute(docs)
    assert op8_suffix_dedup(spark, written(spark, awkward(spark), tmp_path / "more")).count() == len(awkward_rows())


def test_many_chunks_parts_and_hot_keys_give_the_same(spark):
    docs = hard_docs()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    limits = {"chunk_bytes": 3000, "part_bytes": 9000, "array_bytes": 2000}
    expected = brute(docs)
    for hot in (100_000_000, 5000, 0):
        assert rows(without_repeats(frame, digests=True, hot_bytes=hot, **limits)) == expected


def test_kept_bytes_and_spans(spark):
    docs = hard_docs()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in without_repeats(frame).collect()}
    assert bytes(found[207]["kept"]) == b"" and [tuple(s) for s in found[207]["spans"]] == [(0, 420)]
    assert bytes(found[202]["kept"]) == b"xyz" * 40 and found[202]["spans"] == []


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=120) | st.text("ab", min_size=1, max_size=150).map(str.encode))
def test_suffix_arrays(data):
    text = np.frombuffer(data, np.uint8)
    array = suffix_array(text)
    assert array.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    prefixes = permuted_prefixes(text, array)
    for j, i in zip(array, array[1:]):
        n = 0
        while max(i, j) + n < len(data) and data[i + n] == data[j + n]:
            n += 1
        assert prefixes[i] == n


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abc", max_size=90).map(str.encode), min_size=1, max_size=6))
def test_segments_hold_every_window_once_and_equal_windows_share_a_key(parts):
    data, bounds = b"".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    starts, counts, keys, _ = segments(np.frombuffer(data, np.uint8), bounds, 12, 4)
    windows = [(s + i, k) for s, n, k in zip(starts.tolist(), counts.tolist(), keys.tolist()) for i in range(n)]
    inside = [a for low, high in zip(bounds, bounds[1:]) for a in range(low, high - 11)]
    assert [a for a, _ in windows] == inside
    key_of = {}
    for a, k in windows:
        assert key_of.setdefault(data[a : a + 12], k) == k


def test_empty_table(spark, tmp_path):
    assert op8_suffix_dedup(spark, written(spark, empty(spark), tmp_path)).collect() == []

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
from tokenizers import Tokenizer

from tallywatch.llm.packing import balance, cost, op7_packing
from tests.llm.cases import awkward, awkward_rows, empty, small, texts, written


def check(docs, result):
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    wanted = defaultdict(list)
    for i, t in docs:
        wanted[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in result:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(wanted)
    for i, pieces in by_doc.items():
        ends = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces)
        assert sum(e[1] for e in ends) == sum(map(len, wanted[i]))
        for start, length, crc, total in ends:
            assert any(
                len(ids) == total and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
                for ids in wanted[i]
            )
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024
    return sum(map(len, (x for w in wanted.values() for x in w))) / (1024 * len(by_sequence))


def test_query_on_the_small_table(spark, folder):
    assert check(texts(small(spark)), op7_packing(spark, folder).collect()) > 0.98


def test_awkward_rows(spark, tmp_path):
    check([(r[0], r[1]) for r in awkward_rows()], op7_packing(spark, written(spark, awkward(spark), tmp_path)).collect())


def test_empty_table(spark, tmp_path):
    assert op7_packing(spark, written(spark, empty(spark), tmp_path)).collect() == []


def test_costs_are_balanced_and_nothing_is_lost():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1024, 3000).tolist()
    sequences = balance(lengths, 1024)
    assert len(sequences) == -(-sum(lengths) // 1024)
    got = defaultdict(list)
    for s in sequences:
        assert 0 < sum(n for _, _, n in s) <= 1024
        for piece, start, n in s:
            got[piece].append((start, n))
    for piece, parts in got.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == lengths[piece]
    assert len(got) == len(lengths)


def test_equal_pieces_spread_evenly():
    sequences = balance([100] * 30, 1024)
    costs = [sum(cost(n) for _, _, n in s) for s in sequences]
    assert len(sequences) == 3 and max(costs) - min(costs) < 1e-9


def plain_greedy(lengths, capacity):
    """Every sequence looked at for every piece: the cheapest with room, else the emptiest is filled."""
    count = -(-sum(lengths) // capacity)
    sequences = [[] for _ in range(count)]
    room, spent = [capacity] * count, [0.0] * count
    for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        start, left = 0, lengths[piece]
        while left:
            fitting = [i for i in range(count) if room[i] >= left]
            best = min(fitting, key=lambda i: (spent[i], i)) if fitting else min(range(count), key=lambda i: (-room[i], i))
            tokens = min(left, room[best])
            sequences[best].append((piece, start, tokens))
            room[best] -= tokens
            spent[best] += cost(tokens)
            start, left = start + tokens, left - tokens
    return sequences


def test_assignment_matches_a_plain_greedy():
    rng = np.random.default_rng(8)
    for most, n in ((1024, 300), (200, 400), (3000, 60), (1, 50)):
        lengths = rng.integers(1, most + 1, n).tolist()
        assert balance(lengths, 1024) == plain_greedy(lengths, 1024)
    assert balance([], 1024) == [] and balance([512, 512, 512, 512], 1024) == plain_greedy([512] * 4, 1024)

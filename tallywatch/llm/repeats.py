"""Removal of repeated byte strings by suffix arrays.

Every string of ``LENGTH`` bytes (a *window*) that also starts somewhere else is removed, all its
occurrences with it. Windows are dealt to parts by content: a window's key is the smallest hash of
the K-byte strings inside it, so equal windows meet in one part, and neighbouring windows mostly
share a key and travel as one *segment* of bytes. A part builds the suffix arrays of its segments by
induced sorting (tallywatch.llm.suffixes) and reads from the permuted common prefixes which
windows have an equal one. Equal segments are sent and sorted once, with the number of their copies.

Steps: segments per chunk of documents; a first exchange of keys, after which only segments
whose key occurs again are sent; the exchange of their bytes; and per chunk, the removal. A key whose
distinct segments exceed ``HOT_BYTES`` (a short passage within many texts) would gather in one task:
its windows are compared by 128-bit hashes instead, spread over all parts and counted per chunk first.

Defined results: a null text is empty; texts are UTF-8 bytes; texts shorter than a window stay
whole; rows with the same id are separate documents; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import documents, small_batches, stored
from tallywatch.llm.exchange import SENT, bucketed, by_part, joined, packed, packed_ids, sent, split, unpacked, unpacked_ids
from tallywatch.llm.pieces import flat, portions
from tallywatch.llm.suffixes import permuted_prefixes, suffix_array

LENGTH = 200
GRAM = 32
CHUNK_BYTES = 4_000_000
PART_BYTES = 16_000_000
ARRAY_BYTES = 500_000
HOT_BYTES = 2_000_000
MOST_STARTS = 4096  # of one segment
BLOCK = 1 << 20
PLACE = np.uint64((1 << 21) - 1)  # low bits of a hash that give way to its place in a block
CHUNK = (
    "chunk bigint, doc_ids binary, sizes binary, data binary, starts binary, lengths binary, inner binary, "
    "keys binary, digests binary, n_bytes bigint"
)
ANSWER = "chunk bigint, part int, kind int, answer binary"
ALONE, EQUAL_ELSEWHERE, SENDER, HOT = 0, 1, 2, 3
BYTE_HASH = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from every position on; ``gram`` is a power of two."""
    h = BYTE_HASH[data]
    step = 1
    while step < gram:
        h = (h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step)) + h[step:]
        step *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def smallest_in(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    step, out = 1, values
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """First window, number of windows, key, and whether its key's string occurs more than once in
    it, of every segment; together they hold every window of every text exactly once."""
    last = len(data) - length  # the last window of the whole buffer
    if last < 0:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(bool)
    owner_end = np.repeat(bounds[1:], np.diff(bounds))[: last + 1]
    starts, places, keys = [], [], []
    for low in range(0, last + 1, BLOCK):
        high = min(last + 1, low + BLOCK)
        h = gram_hashes(data[low : high + length - 1], gram)
        ordered = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        place = (smallest_in(ordered, length - gram + 1) & PLACE).astype(np.int64)
        inside = np.arange(low, high) + length <= owner_end[low:high]
        # Runs of windows inside a text with the same smallest string at the same place.
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])])
        at = np.flatnonzero(new & inside)
        starts.append(low + at)
        places.append(low + place[at])
        keys.append(h[place[at]])
        ends = np.flatnonzero(np.append(new[1:], True) & inside)
        places[-1] = np.stack([places[-1], low + ends])
    starts, keys = np.concatenate(starts), np.concatenate(keys)
    places, ends = np.concatenate(places, axis=1)
    # Neighbouring runs with equal strings are one segment (periodic texts would else fall to pieces).
    owner = np.searchsorted(bounds, starts, side="right")
    joins = (starts[1:] == ends[:-1] + 1) & (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~joins])) if len(starts) else np.empty(0, np.int64)
    if not len(first):
        return first, first, keys, first.astype(bool)
    final = np.append(first[1:], len(starts)) - 1
    inner = places[final] != places[first]
    a, n, keys = starts[first], ends[final] - starts[first] + 1, keys[first]
    pieces = -(-n // MOST_STARTS)
    if (pieces > 1).any():  # windows of one long run still share their key
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        a, n, keys, inner = (np.repeat(x, pieces) for x in (a, n, keys, inner))
        a, n = a + nth * MOST_STARTS, np.minimum(n - nth * MOST_STARTS, MOST_STARTS)
    return a, n, keys, inner


def _chunk_rows(batches: Iterator[pa.RecordBatch], most: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
    made, size = 0, 0
    waiting: list[tuple] = []

    def emit() -> pa.RecordBatch:
        nonlocal made, size
        ids, texts = (list(c) for c in zip(*waiting))
        data, bounds = flat(texts)
        starts, counts, keys, inner = segments(np.frombuffer(data, np.uint8), bounds, length, gram)
        digest = xxhash.xxh3_64_intdigest
        ends = starts + counts + length - 1
        digests = np.array([digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
        values = [
            task + made, packed_ids(ids), packed(np.diff(bounds)), data, packed(starts), packed(counts.astype(np.uint16)),
            np.packbits(inner).tobytes(), keys.tobytes(), digests.tobytes(), len(data),
        ]
        kinds = [pa.int64(), *[pa.binary()] * 8, pa.int64()]
        names = [f.split()[0] for f in CHUNK.split(", ")]
        made, size = made + 1, 0
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        for low, high in portions(texts, most):
            for i in range(low, high):
                if waiting and size + len(texts[i]) > most:
                    yield emit()
                waiting.append((ids[i], texts[i]))
                size += len(texts[i])
    if waiting:
        yield emit()


class Chunk:
    """One chunk; equal segments in it are one *entry*, and all steps derive the same order of them."""

    def __init__(self, row, parts: int, length: int):
        self.parts, self.length = parts, length
        self.doc_ids, self.data = unpacked_ids(row["doc_ids"]), row["data"]
        self.bounds = np.concatenate([[0], np.cumsum(unpacked(row["sizes"], np.int64))])
        starts, counts = unpacked(row["starts"], np.int64), unpacked(row["lengths"], np.uint16).astype(np.int64)
        keys, digests = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["digests"], np.uint64)
        inner = np.unpackbits(np.frombuffer(row["inner"], np.uint8), count=len(starts)).astype(bool)
        order = np.lexsort((digests, keys))
        new = np.ones(len(order), bool)
        new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (digests[order[1:]] != digests[order[:-1]])
        one_of_each = order[new]
        self.copies = np.diff(np.append(np.flatnonzero(new), len(order)))
        by, self.cuts = by_part(keys[one_of_each], parts)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.copies = self.copies[by]
        one_of_each = one_of_each[by]
        self.entry_of = np.empty(len(order), np.int64)
        self.entry_of[order] = place[np.cumsum(new) - 1]
        self.all_starts = starts
        self.starts, self.counts, self.inner = starts[one_of_each], counts[one_of_each], inner[one_of_each]
        self.keys, self.digests = keys[one_of_each], digests[one_of_each]

    def bytes_of(self, entry: int) -> bytes:
        a = int(self.starts[entry])
        return self.data[a : a + int(self.counts[entry]) + self.length - 1]

    def windows(self, entries: np.ndarray):
        """Distinct windows of hot entries as two hashes in part order, their numbers, where each
        part starts, and the distinct window of every window."""
        digest = xxhash.xxh3_128_digest
        found = []
        for e in entries.tolist():
            own = self.bytes_of(e)
            found += [digest(own[i : i + self.length]) for i in range(int(self.counts[e]))]
        both = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
        order = np.lexsort((both[:, 1], both[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (both[order[1:]] != both[order[:-1]]).any(axis=1)
        weight = np.repeat(self.copies[entries], self.counts[entries])
        copies = np.add.reduceat(weight[order], np.flatnonzero(new)) if len(order) else weight
        distinct = both[order[new]]
        by, cuts = by_part(distinct[:, 0].astype(np.uint64), self.parts)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        of = np.empty(len(order), np.int64)
        of[order] = place[np.cumsum(new) - 1]
        return distinct[by], copies[by], cuts, of


def _send_keys(chunk_id: int, chunk: Chunk) -> pd.DataFrame:
    rows = []
    for p in np.flatnonzero(np.diff(chunk.cuts)).tolist():
        own = slice(chunk.cuts[p], chunk.cuts[p + 1])
        payload = joined(
            chunk.keys[own].tobytes(), chunk.digests[own].tobytes(), packed(chunk.counts[own].astype(np.uint16)),
            packed(chunk.copies[own].astype(np.uint32)), np.packbits(chunk.inner[own]).tobytes(),
        )
        rows.append((p, chunk_id, payload))
    return sent(rows)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order by the columns (last one first), and which rows start a new combination."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, new


def _serve_keys(part: int, received: pd.DataFrame, length: int, hot_bytes: int) -> pd.DataFrame:
    """Per entry: alone, equal to one that another chunk sends, to be sent, or of a hot key."""
    halves = [split(p, 5) for p in received["payload"]]
    keys = np.concatenate([np.frombuffer(h[0], np.uint64) for h in halves])
    digests = np.concatenate([np.frombuffer(h[1], np.uint64) for h in halves])
    counts = np.concatenate([unpacked(h[2], np.uint16) for h in halves]).astype(np.int64)
    copies = np.concatenate([unpacked(h[3], np.uint32) for h in halves]).astype(np.int64)
    sizes = [len(h[0]) // 8 for h in halves]
    inner = np.concatenate([np.unpackbits(np.frombuffer(h[4], np.uint8), count=n) for h, n in zip(halves, sizes)])
    order, new_pair = _runs(digests, keys)
    ordered = keys[order]
    new_key = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    groups, of_key = np.flatnonzero(new_key), np.cumsum(new_key) - 1
    again = np.add.reduceat(copies[order] + inner[order], groups) > 1
    size = np.add.reduceat(np.where(new_pair, counts[order] + length - 1, 0), groups)
    verdict = np.where(again[of_key], np.where(new_pair, SENDER, EQUAL_ELSEWHERE), ALONE)
    verdict = np.where(again[of_key] & (size > hot_bytes)[of_key], HOT, verdict)
    out = np.empty(len(order), np.uint8)
    out[order] = verdict
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    rows = [(c, part, 1, out[a:b].tobytes()) for c, a, b in zip(received["chunk"].tolist(), cuts, cuts[1:])]
    return pd.DataFrame(rows, columns=["chunk", "part", "kind", "answer"])


def _verdicts(answers: pd.DataFrame) -> np.ndarray:
    got = answers[answers["kind"] == 1].sort_values("part")["answer"]
    return np.frombuffer(b"".join(got), np.uint8)


def _send_bytes(chunk_id: int, chunk: Chunk, answers: pd.DataFrame) -> pd.DataFrame:
    verdict = _verdicts(answers)
    distinct, copies, cuts, _ = chunk.windows(np.flatnonzero(verdict == HOT))
    rows = []
    for p in np.flatnonzero(np.diff(chunk.cuts) + np.diff(cuts)).tolist():
        own = np.arange(chunk.cuts[p], chunk.cuts[p + 1])
        own = own[(verdict[own] == EQUAL_ELSEWHERE) | (verdict[own] == SENDER)]
        hot = slice(cuts[p], cuts[p + 1])
        if not len(own) and cuts[p] == cuts[p + 1]:
            continue
        sends = verdict[own] == SENDER
        payload = joined(
            chunk.keys[own].tobytes(), chunk.digests[own].tobytes(), packed(chunk.counts[own].astype(np.uint16)),
            packed(chunk.copies[own].astype(np.uint32)), np.packbits(sends).tobytes(),
            b"".join(chunk.bytes_of(e) for e in own[sends].tolist()),
            distinct[hot].tobytes(), packed(copies[hot].astype(np.uint32)),
        )
        rows.append((p, chunk_id, payload))
    return sent(rows)


def repeated_windows(texts: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For every segment, which of its windows occur again, in it, its copies or another one."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    array = suffix_array(data)
    shared = permuted_prefixes(data, array)[array]
    group = np.cumsum(shared < length)
    # Only suffixes with a whole window inside their own segment count.
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    windows = sizes - length + 1
    weight = np.repeat(copies, sizes)
    weight[np.arange(len(data)) > np.repeat(ends - length, sizes)] = 0
    total = np.bincount(group, weights=weight[array])
    again = np.empty(len(data), bool)
    again[array] = total[group] > 1
    return [again[e - s : e - s + w] for e, s, w in zip(ends.tolist(), sizes.tolist(), windows.tolist())]


def _serve_bytes(part: int, received: pd.DataFrame, length: int, array_bytes: int) -> pd.DataFrame:
    sent_rows = []
    for payload in received["payload"]:
        keys, digests, counts, copies, sends, texts, hot, hot_copies = split(payload, 8)
        counts = unpacked(counts, np.uint16).astype(np.int64)
        sends = np.unpackbits(np.frombuffer(sends, np.uint8), count=len(counts)).astype(bool)
        lengths = np.where(sends, counts + length - 1, 0)
        ends = np.cumsum(lengths)
        sent_rows.append(
            (
                np.frombuffer(keys, np.uint64), np.frombuffer(digests, np.uint64), counts,
                unpacked(copies, np.uint32).astype(np.int64), texts, ends - lengths, sends,
                np.frombuffer(hot, "<u8").reshape(-1, 2), unpacked(hot_copies, np.uint32).astype(np.int64),
            )
        )
    keys, digests, counts, copies = (np.concatenate([r[i] for r in sent_rows]) for i in range(4))
    owner = np.repeat(np.arange(len(sent_rows)), [len(r[0]) for r in sent_rows])
    at = np.concatenate([r[5] for r in sent_rows])
    sends = np.concatenate([r[6] for r in sent_rows])
    order, new = _runs(digests, keys)
    firsts = np.flatnonzero(new)
    pair_of = np.empty(len(order), np.int64)
    pair_of[order] = np.cumsum(new) - 1
    total = np.add.reduceat(copies[order], firsts) if len(order) else copies
    sender = np.zeros(len(firsts), np.int64)
    sender[pair_of[sends]] = np.flatnonzero(sends)
    pair_keys = keys[order][new]
    found: list[bytes] = [b""] * len(firsts)
    batch: list[int] = []
    texts: list[bytes] = []
    size = 0

    def sort_batch() -> None:
        for pair, again in zip(batch, repeated_windows(texts, total[batch], length)):
            found[pair] = np.packbits(again).tobytes()
        batch.clear()
        texts.clear()

    for pair in range(len(firsts)):
        if size > array_bytes and pair_keys[pair] != pair_keys[pair - 1]:  # segments of a key stay together
            sort_batch()
            size = 0
        s = int(sender[pair])
        own = sent_rows[owner[s]][4][at[s] : at[s] + counts[s] + length - 1]
        batch.append(pair)
        texts.append(own)
        size += len(own)
    if batch:
        sort_batch()

    hot = np.concatenate([r[7] for r in sent_rows])
    hot_order, hot_new = _runs(hot[:, 1], hot[:, 0])
    again = np.empty(len(hot), bool)
    if len(hot):
        many = np.add.reduceat(np.concatenate([r[8] for r in sent_rows])[hot_order], np.flatnonzero(hot_new)) > 1
        again[hot_order] = many[np.cumsum(hot_new) - 1]
    rows, low, hot_low = [], 0, 0
    for chunk, r in zip(received["chunk"].tolist(), sent_rows):
        pairs = pair_of[low : low + len(r[0])].tolist()
        mine = np.packbits(again[hot_low : hot_low + len(r[7])]).tobytes()
        rows.append((chunk, part, 2, joined(b"".join(found[p] for p in pairs), mine)))
        low, hot_low = low + len(r[0]), hot_low + len(r[7])
    return pd.DataFrame(rows, columns=["chunk", "part", "kind", "answer"])


def _cut(chunk: Chunk, answers: pd.DataFrame) -> Iterator[tuple]:
    """Per document: id, its bytes, and which of them go."""
    verdict = _verdicts(answers)
    hot_entries = np.flatnonzero(verdict == HOT)
    _, _, cuts, of = chunk.windows(hot_entries)
    got = dict(zip(*(answers[answers["kind"] == 2][c].tolist() for c in ("part", "answer"))))
    again: list[np.ndarray | None] = [None] * len(verdict)
    hot_again = np.zeros(int(cuts[-1]), bool)
    for p, answer in got.items():
        bits, hot = split(answer, 2)
        hot_again[cuts[p] : cuts[p + 1]] = np.unpackbits(np.frombuffer(hot, np.uint8), count=cuts[p + 1] - cuts[p])
        at = 0
        for e in range(chunk.cuts[p], chunk.cuts[p + 1]):
            if verdict[e] in (EQUAL_ELSEWHERE, SENDER):
                n = int(chunk.counts[e])
                own = np.frombuffer(bits[at : at + (n + 7) // 8], np.uint8)
                again[e] = np.unpackbits(own, count=n).astype(bool)
                at += (n + 7) // 8
    at = 0
    for e in hot_entries.tolist():
        n = int(chunk.counts[e])
        again[e] = hot_again[of[at : at + n]]
        at += n
    edges = np.zeros(len(chunk.data) + 1, np.int32)
    for start, e in zip(chunk.all_starts.tolist(), chunk.entry_of.tolist()):
        if again[e] is not None:
            begins = start + np.flatnonzero(again[e])
            edges[begins] += 1
            edges[begins + chunk.length] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    data = np.frombuffer(chunk.data, np.uint8)
    for i, doc_id in enumerate(chunk.doc_ids):
        own = slice(chunk.bounds[i], chunk.bounds[i + 1])
        yield doc_id, data[own], gone[own]


def _rows(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """A frame whose first column holds ids, null or not, without going through doubles."""
    columns = dict(zip(names, zip(*rows)))
    return pd.DataFrame(columns | {names[0]: pd.array(list(columns[names[0]]), "Int64")})


def _digest_rows(chunk: Chunk, answers: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for doc_id, data, gone in _cut(chunk, answers):
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = hashlib.sha256(data[~gone].tobytes()).hexdigest()
        rows.append((doc_id, len(data), int(gone.sum()), spans, kept))
    return _rows(rows, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept_rows(chunk: Chunk, answers: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for doc_id, data, gone in _cut(chunk, answers):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
        rows.append((doc_id, data[~gone].tobytes(), [{"start": int(a), "end": int(b)} for a, b in edges]))
    return _rows(rows, ["doc_id", "kept", "spans"])


DIGESTS = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
KEPT = "doc_id bigint, kept binary, spans array<struct<start: bigint, end: bigint>>"


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    digests: bool = False,
    gram: int = GRAM,
    chunk_bytes: int = CHUNK_BYTES,
    part_bytes: int = PART_BYTES,
    array_bytes: int = ARRAY_BYTES,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """doc_id, the kept bytes and the removed spans of every document; or their digest."""
    if not 1 <= gram <= length or gram & (gram - 1) or length > BLOCK // 2:
        raise ValueError("gram must be a power of two of at most the length, and the length below 2**19")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = rows.mapInArrow(lambda batches: _chunk_rows(batches, chunk_bytes, length, gram), CHUNK)
    chunks = bucketed(made, "byte_chunks")
    size = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))

    def chunk_of(frame: pd.DataFrame) -> tuple[int, Chunk]:
        return int(frame["chunk"].iat[0]), Chunk(frame.iloc[0], parts, length)

    def send_keys(frame: pd.DataFrame) -> pd.DataFrame:
        return _send_keys(*chunk_of(frame))

    def serve_keys(key: tuple, received: pd.DataFrame) -> pd.DataFrame:
        return _serve_keys(int(key[0]), received, length, hot_bytes)

    def send_bytes(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _send_bytes(*chunk_of(frame), answers)

    def serve_bytes(key: tuple, received: pd.DataFrame) -> pd.DataFrame:
        return _serve_bytes(int(key[0]), received, length, array_bytes)

    def cut(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return (_digest_rows if digests else _kept_rows)(chunk_of(frame)[1], answers)

    asked = chunks.drop("n_bytes").groupBy("chunk").applyInPandas(send_keys, SENT)
    lookup = stored(asked.groupBy("part").applyInPandas(serve_keys, ANSWER), "repeat-keys")
    asked = chunks.groupBy("chunk").cogroup(lookup.groupBy("chunk")).applyInPandas(send_bytes, SENT)
    found = stored(asked.groupBy("part").applyInPandas(serve_bytes, ANSWER), "repeat-bytes")
    answers = lookup.unionByName(found)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(cut, DIGESTS if digests else KEPT)


def op8_suffix_dedup(spark, folder: str) -> DataFrame:
    return without_repeats(documents(spark, folder), digests=True)

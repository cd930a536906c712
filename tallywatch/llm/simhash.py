"""SimHash near-dedup by pigeonhole blocks.

A fingerprint has 64 bits in ``BLOCKS`` blocks. Two fingerprints that differ in at most d bits
agree in at least BLOCKS - d whole blocks, so every close pair shares the key of some choice of
BLOCKS - d blocks. Equal fingerprints are merged first; distinct ones meet in the group of a key,
and a link counts only after its Hamming distance is verified. A group emits the edges of a
spanning forest of its links, not its pairs. Components follow from the edges by alternating
star contractions, each round a stored table.

Defined results: a null or wordless text has fingerprint zero; rows with the same id are separate
texts; a null id is never the smallest unless it is alone; an empty table gives no rows; extra
columns are ignored (kept by ``one_per_group``), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywatch.llm.common import documents, small_batches, stored

SHINGLE = 4
DISTANCE = 4
BLOCKS = 7
SHINGLES_AT_ONCE = 200_000
FEW = 32
SIDE = 2048
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _digests(text: bytes | None, shingle: int) -> Iterator[list[bytes]]:
    """XXH64 digests (seed 42) of the shingles of a UTF-8 text, some at a time.

    Case and white space of bytes are those of ASCII.
    """
    words = (text or b"").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(joined)]])
    digest = xxhash.xxh64_digest
    if len(words) < shingle:
        yield [digest(joined, 42)]
        return
    starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        yield [digest(joined[a:b], 42) for a, b in zip(starts[part].tolist(), ends[part].tolist())]


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of every text: bits set in over half of its shingle hashes."""
    set_in = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    waiting: list[bytes] = []
    owners: list[tuple[int, int]] = []

    def count() -> None:
        if not waiting:
            return
        codes = np.frombuffer(b"".join(waiting), np.uint8).reshape(-1, 8)
        docs = [d for d, _ in owners]
        local = np.repeat(np.arange(len(docs)), [n for _, n in owners])
        for byte in range(8):
            seen = np.bincount(local * 256 + codes[:, byte], minlength=len(docs) * 256)
            np.add.at(set_in[:, byte * 8 : byte * 8 + 8], docs, seen.reshape(-1, 256) @ BITS)
        waiting.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for digests in _digests(text, shingle):
            waiting.extend(digests)
            owners.append((i, len(digests)))
            total[i] += len(digests)
            if len(waiting) >= SHINGLES_AT_ONCE:
                count()
    count()
    packed = np.packbits(set_in * 2 > total[:, None], axis=1)
    return packed.view(">u8").ravel().astype(np.uint64)


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """One mask for every choice of blocks - distance blocks, as signed 64-bit numbers."""
    if blocks <= distance:
        raise ValueError("more blocks than differing bits are needed")
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(np.arange(64), blocks)]
    masks = (sum(choice) for choice in combinations(parts, blocks - distance))
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


class _Forest:
    """Union-find over the fingerprints that have links in one task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


def _links_of_group(values: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Verified links that connect one group of any size, found without listing its pairs.

    Members near the first open one link to it and are done with it; what is left does the same
    with its own first, until all have met one. Sets found so are then compared with each other
    in squares of bounded size, only while they are not connected.
    """
    own = _Forest()
    order, leaders, rest = [], [], np.arange(len(values))
    while len(rest):
        near = np.bitwise_count(values[rest] ^ values[rest[0]]) <= distance
        mine = rest[near]
        for x in mine[1:].tolist():
            own.join(int(mine[0]), x)
            yield int(values[mine[0]]), int(values[x])
        order.append(mine)
        leaders.append(int(mine[0]))
        rest = rest[~near]
    for i in range(len(order)):
        open_sets = [j for j in range(i + 1, len(order)) if own.root(leaders[i]) != own.root(leaders[j])]
        if not open_sets:
            continue
        others = np.concatenate([order[j] for j in open_sets])
        owner = np.repeat(open_sets, [len(order[j]) for j in open_sets])
        for a in range(0, len(order[i]), SIDE):
            left = order[i][a : a + SIDE]
            for b in range(0, len(others), SIDE):
                right = others[b : b + SIDE]
                close = np.bitwise_count(values[left][:, None] ^ values[right][None, :]) <= distance
                hit = close.any(axis=0)
                for c in np.flatnonzero(hit).tolist():
                    if own.join(leaders[i], leaders[int(owner[b + c])]):
                        yield int(values[left[int(close[:, c].argmax())]]), int(values[right[c]])


def _edges(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the verified links inside the groups of rows sorted by key."""
    forest = _Forest()
    found: list[tuple[int, int]] = []

    def take(a: int, b: int) -> None:
        if forest.join(a, b):
            found.append((a, b))

    def groups(keys: np.ndarray, values: np.ndarray) -> None:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts = np.concatenate([[0], cuts])
        lengths = np.diff(np.concatenate([starts, [len(keys)]]))
        small = np.repeat(lengths <= FEW, lengths)
        for step in range(1, min(FEW, int(lengths.max(initial=1)))):
            same = (keys[:-step] == keys[step:]) & small[step:]
            at = np.flatnonzero(same)
            if not len(at):
                break
            at = at[np.bitwise_count(values[at] ^ values[at + step]) <= distance]
            for a, b in zip(values[at].tolist(), values[at + step].tolist()):
                take(a, b)
        for i in np.flatnonzero(lengths > FEW).tolist():
            for a, b in _links_of_group(values[starts[i] : starts[i] + lengths[i]], distance):
                take(a, b)

    def flush() -> pa.RecordBatch:
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        found.clear()
        return pa.record_batch({"u": pa.array(pairs.max(axis=1)), "v": pa.array(pairs.min(axis=1))})

    held: list[tuple[np.ndarray, np.ndarray]] = []  # pieces of one key that may go on in the next batch
    for batch in batches:
        keys = batch.column("key").to_numpy()
        values = batch.column("fp").to_numpy().view(np.uint64)
        if not len(keys):
            continue
        if held and keys[0] != held[-1][0][-1] or held and keys[-1] != keys[0]:
            cut = int(np.searchsorted(keys != held[-1][0][-1], True))
            groups(
                np.concatenate([k for k, _ in held] + [keys[:cut]]), np.concatenate([v for _, v in held] + [values[:cut]])
            )
            held, keys, values = [], keys[cut:], values[cut:]
        if not held and keys[0] != keys[-1]:
            last = len(keys) - int(np.searchsorted(keys[::-1] != keys[-1], True))
            groups(keys[:last], values[:last])
            keys, values = keys[last:], values[last:]
        held.append((keys, values))
        if len(found) > 10_000:
            yield flush()
    if held:
        groups(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))
    if found:
        yield flush()


def close_edges(values: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Edges (u > v) whose components are those of all links among distinct fingerprints ``fp``."""
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(blocks, distance))))
    keyed = values.select("fp", F.explode(keys).alias("key")).select("key", "fp")
    small_batches(values.sparkSession, 65_536)
    grouped = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return grouped.mapInArrow(lambda batches: _edges(batches, distance), "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges; root is the smallest node of its component.

    Alternating large-star and small-star contractions; minima combine before the shuffle and a
    hot centre meets its neighbours in a join that adaptive execution can split.
    """

    def star(rows: DataFrame, large: bool) -> DataFrame:
        around = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else rows
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = around.join(least, "u")
        if large:
            return met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        moved = met.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    def print_of(rows: DataFrame):
        return rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    rows = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = print_of(rows)
    while True:
        rows = stored(star(star(rows, True), False), "stars")
        now = print_of(rows)
        if now == before:
            return rows.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def fingerprint_table(docs: DataFrame, keep: list[Column], shingle: int = SHINGLE) -> DataFrame:
    """``keep`` and fp (the fingerprint as a signed bigint) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    names = [c for c in rows.columns if c != "_text"]
    schema = rows.select(*names).schema.add("fp", T.LongType())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(batch.column("_text").cast(pa.binary()).to_pylist(), shingle).view(np.int64)
            columns = [batch.column(n) for n in names] + [pa.array(found)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "fp"])

    return stored(rows.mapInArrow(task, schema), "fingerprints")


def with_components(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Adds root (one fingerprint per component) and component_id, the smallest doc_id reachable
    over links; ``prints`` has doc_id and fp."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = components(stored(close_edges(nodes.select("fp"), distance, blocks), "edges"))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(labels, "fp")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_per_group(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of the smallest doc_id of every component, one row of each."""
    row_hash = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    prints = fingerprint_table(docs, [F.col("doc_id"), row_hash.alias("row_hash")], shingle)
    labelled = with_components(prints, distance, blocks)
    # Among rows of the smallest id (null: none in the group has an id) one is taken by its hash.
    stay = (
        labelled.groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_hash")).alias("best"))
        .select(F.col("best.doc_id").alias("stay_id"), F.col("best.row_hash").alias("stay_hash"))
        .distinct()
    )
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own)), F.col("doc_id").alias("k_id"), row_hash.alias("k_hash")
    )
    met = rows.join(stay, (F.col("k_hash") == F.col("stay_hash")) & F.col("k_id").eqNullSafe(F.col("stay_id")), "left_semi")
    # Equal rows have equal keys; one of them stays.
    return met.dropDuplicates(["k_id", "k_hash"]).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, own)))


def op5_simhash(spark, folder: str) -> DataFrame:
    prints = fingerprint_table(documents(spark, folder), [F.col("doc_id")])
    return with_components(prints).select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")

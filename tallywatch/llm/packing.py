"""Cost-balanced packing of token sequences.

A piece of n tokens costs a linear part plus a quadratic attention part. Documents give off whole
sequences as long as they can; the remainders of a few thousand documents at a time are packed in
descending order, each into the sequence of lowest cost that still has room for it. There are no
more sequences than the tokens need, so a remainder may meet no room; it is then cut and fills the
emptiest ones. Tasks pack their own documents: nothing is shuffled, a task holds one pool, and a
lost task repeats the same pools.

Defined results: a null text is empty and has the one token that ends every document; rows with
equal ids are separate documents; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import documents, small_batches
from tallywatch.llm.pieces import default_paths, portions, token_ids

LENGTH = 1024
POOL = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
END_ID = 0
OUT = (
    "doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


def cost(tokens: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * tokens + quadratic * tokens * tokens


def balance(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start in it, tokens): descending pieces to the cheapest sequence with room."""
    count = -(-sum(lengths) // capacity)
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    room = [capacity] * count
    spent = [0.0] * count
    cheap = [(0.0, i) for i in range(count)]  # by cost
    wide = [(-capacity, i) for i in range(count)]  # by room

    def put(i: int, piece: int, start: int, tokens: int) -> None:
        sequences[i].append((piece, start, tokens))
        room[i] -= tokens
        spent[i] += cost(tokens)
        if room[i]:
            heapq.heappush(cheap, (spent[i], i))
            heapq.heappush(wide, (-room[i], i))

    for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        start, left = 0, lengths[piece]
        while left:
            while wide[0][0] != -room[wide[0][1]]:
                heapq.heappop(wide)
            if -wide[0][0] < left:  # fits nowhere: fill the emptiest
                tokens, i = -wide[0][0], wide[0][1]
                put(i, piece, start, tokens)
                start, left = start + tokens, left - tokens
                continue
            passed = []
            while True:
                spent_then, i = heapq.heappop(cheap)
                if spent_then != spent[i] or not room[i]:
                    continue
                if room[i] >= left:
                    break
                passed.append((spent_then, i))
            for entry in passed:
                heapq.heappush(cheap, entry)
            put(i, piece, start, left)
            left = 0
    return sequences


def _pack(batches: Iterator[pa.RecordBatch], paths, length: int, pool: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
    made = 0
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows: list[tuple] = []
    waiting: list[tuple] = []  # doc_id, start, ids, tokens of the document

    def place(doc_id, start: int, ids: np.ndarray, tokens: int, sequence: int, offset: int) -> None:
        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence, offset))

    def pack_waiting() -> None:
        nonlocal made
        for sequence in balance([len(w[2]) for w in waiting], length):
            offset = 0
            for piece, start, tokens in sequence:
                doc_id, before, ids, total = waiting[piece]
                place(doc_id, before + start, ids[start : start + tokens], total, task + made, offset)
                offset += tokens
            made += 1
        waiting.clear()

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows))
        rows.clear()
        kinds = [kind] + [pa.int64()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        for low, high in portions(texts):
            ids, bounds = token_ids(texts[low:high], paths)
            for i in range(high - low):
                own = np.append(ids[bounds[i] : bounds[i + 1]], END_ID)
                whole = len(own) // length * length
                for start in range(0, whole, length):
                    place(doc_ids[low + i], start, own[start : start + length], len(own), task + made, 0)
                    made += 1
                if whole < len(own):
                    waiting.append((doc_ids[low + i], whole, own[whole:].astype(np.int32), len(own)))
                if len(waiting) >= pool:
                    pack_waiting()
            if rows:
                yield out()
    pack_waiting()
    if rows:
        yield out()


def pack(docs: DataFrame, paths=None, length: int = LENGTH, pool: int = POOL) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    small_batches(docs.sparkSession)
    paths = paths or default_paths()
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType
    kind = pa.int32() if id_type.typeName() == "integer" else pa.int64()
    schema = OUT.format(kind=id_type.simpleString())
    return rows.mapInArrow(lambda batches: _pack(batches, paths, length, pool, kind), schema)


def op7_packing(spark, folder: str) -> DataFrame:
    return pack(documents(spark, folder))

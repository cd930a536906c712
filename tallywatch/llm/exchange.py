"""Packed arrays that chunks of documents and parts of a model send each other.

A *chunk* is a stored group of documents of bounded size; a *part* is a range of hashes. A chunk
sends each part one row with the entries that hash to it, already counted within the chunk, and the
part answers each chunk in the order of the entries. Rows of a shuffle are then as large as
a payload, whatever the number of entries.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallywatch.session import ensure_checkpoint_dir

SENT = "part int, chunk bigint, payload binary"


def packed(values: np.ndarray) -> bytes:
    """Byte planes: they compress well, whatever the width of the numbers."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpacked(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, len(data) // width)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def packed_ids(ids: list[int | None]) -> bytes:
    """Ids and which of them are null; an array column with nulls would come back as doubles."""
    null = np.array([i is None for i in ids], bool)
    return joined(packed(np.array([i or 0 for i in ids], np.int64)), np.packbits(null).tobytes())


def unpacked_ids(data: bytes) -> list[int | None]:
    values, null = split(data, 2)
    ids = unpacked(values, np.int64).tolist()
    return [None if n else i for i, n in zip(ids, np.unpackbits(np.frombuffer(null, np.uint8)))]


def joined(*arrays: bytes) -> bytes:
    return np.array([len(a) for a in arrays], "<u4").tobytes() + b"".join(arrays)


def split(data: bytes, n: int) -> list[bytes]:
    cuts = 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(data[: 4 * n], "<u4").astype(np.int64))])
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def by_part(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries in the order of their parts (stable), and where each part starts in that order."""
    part = (mixed(hashes) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


def sent(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "chunk", "payload"])


def bucketed(df: DataFrame, name: str) -> DataFrame:
    """Stores chunks in a table bucketed by chunk: later steps group them without moving them."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{table}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(table)
    return spark.table(table)

"""Exact top-k inner products, block at a time with pruning.

Vectors become integer weights per term (dimension). Ranges of rows by id form blocks; a block
keeps its forward index (the weights of its rows) and, per term, its largest and smallest weight.
The largest score that a row of a block can reach with a query is the sum over the terms of the
query weight times that maximum (or minimum, for a negative query weight). A query visits the
blocks in descending order of that bound and stops when the bound falls below its k-th score;
a bound equal to it is still visited, since ties go to the smaller id.

Blocks are gathered in shards of a fixed number of rows and queries in groups of a fixed size, so
a task scores one group against one shard. A first round scores every group against one shard;
its k-th scores are a floor for the others and prune them from the start.

Defined results: vectors that are null, empty, or hold null, NaN or infinite components take no
part; shorter vectors count as padded with zeros; a null id sorts last and is no query; rows with
the id of a query are its own and no candidates of it; equal rows with another id each take a
rank; an empty table gives no rows; extra columns are ignored. Weights of any size that a long holds are
multiplied exactly; one beyond a long (a component of 2**55 or more), or a listed score beyond one,
makes the query fail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.llm.common import documents, stored

BLOCK = 128
SHARD_ROWS = 16_384
QUERY_GROUP = 1_024
WAVE = 8
NO_ID = np.iinfo(np.int64).max


def term_weights(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, null where the vector takes no part."""
    big = F.transform(embedding, lambda x: x.cast("double") * scale)
    fine = F.forall(big, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & fine, F.transform(big, lambda x: F.floor(x)))


def _matrix(rows, width: int | None = None) -> np.ndarray:
    width = width or max(map(len, rows))
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    if out.size and max(int(out.max()), -int(out.min())) >= NO_ID:  # where Spark's floor ends
        raise ValueError("a weight does not fit a long")
    return out


def _fit(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))) if matrix.shape[1] < width else matrix


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(row of the query, its id, row id, score) of the k best rows of a shard for every query."""
    rows = rows.sort_values("vec_id", kind="stable")
    ids = rows["vec_id"].to_numpy(np.int64)
    index = _matrix(rows["weights"].tolist())
    wanted = _matrix(queries["weights"].tolist())
    width = max(index.shape[1], wanted.shape[1])
    index, wanted = _fit(index, width), _fit(wanted, width)
    largest = int(np.abs(index).max(initial=0)) * int(np.abs(wanted).max(initial=0)) * width
    # Sums of exact integers below 2**53 are exact in doubles, whose products are much faster; beyond
    # longs the products are those of Python's integers.
    kind = np.float64 if largest < 2**53 else np.int64 if largest < 2**63 else object
    index, wanted = index.astype(kind), wanted.astype(kind)

    starts = np.arange(0, len(ids), BLOCK)
    tops = np.maximum.reduceat(index, starts, axis=0)
    lows = np.minimum.reduceat(index, starts, axis=0)
    bounds = np.maximum(wanted, 0) @ tops.T + np.minimum(wanted, 0) @ lows.T
    orders = np.argsort(-bounds, axis=1, kind="stable")
    floors = queries["floor_score"].to_numpy(object)
    for q, (own, floor) in enumerate(zip(queries["vec_id"].tolist(), floors)):
        best_ids, best = np.empty(0, np.int64), np.empty(0, kind)
        kth = None if floor is None or pd.isna(floor) else int(floor)
        for at in range(0, len(starts), WAVE):
            visited = orders[q, at : at + WAVE]
            if kth is not None:
                visited = visited[bounds[q, visited] >= kth]
                if not len(visited):
                    break
            picked = (starts[visited][:, None] + np.arange(BLOCK)).ravel()
            picked = picked[picked < len(ids)]
            picked = picked[ids[picked] != own]
            best = np.concatenate([best, index[picked] @ wanted[q]])
            best_ids = np.concatenate([best_ids, ids[picked]])
            top = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[top], best_ids[top]
            if len(best) == k:
                kth = int(best[-1]) if kth is None else max(kth, int(best[-1]))
        for vec_id, score in zip(best_ids.tolist(), best.tolist()):
            yield q, own, vec_id, int(score)


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows of every query row.

    ``vectors`` has vec_id and weights (array<bigint>, null: no part).
    """
    usable = vectors.filter(F.col("weights").isNotNull())
    usable = stored(usable.select(F.coalesce("vec_id", F.lit(int(NO_ID))).alias("vec_id"), "weights", is_query.alias("asks")), "vectors")
    total = usable.count()
    shards = max(1, -(-total // SHARD_ROWS))
    # Ranges of ids; equal ids are told apart, so that no range grows with repeated rows.
    ranged = usable.repartitionByRange(shards, "vec_id", F.xxhash64("weights"), F.rand(7))
    rows = stored(ranged.select("vec_id", "weights", F.spark_partition_id().alias("shard")), "vector-ranges")

    asked = usable.filter(F.col("asks") & (F.col("vec_id") != int(NO_ID))).select("vec_id", "weights").distinct()
    groups = max(1, -(-asked.count() // QUERY_GROUP))
    asked = asked.withColumn("grp", F.pmod(F.xxhash64("vec_id", "weights"), F.lit(groups)).cast("int"))
    asked = stored(asked, "queries")

    def scored(queries: DataFrame, shards_of_group: Column) -> DataFrame:
        left = queries.withColumn("shard", F.explode(shards_of_group))
        right = rows.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        if groups > 1:  # only the (group, shard) pairs of this round
            right = right.join(left.select("grp", "shard").distinct(), ["grp", "shard"], "left_semi")

        def task(key, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            names = ["query_id", "qhash", "vec_id", "score"]
            if q.empty or r.empty:
                return pd.DataFrame(columns=names)
            found = [(own, int(q["qhash"].iat[i]), v, s) for i, own, v, s in _search(q, r, k)]
            return pd.DataFrame(found, columns=names)

        return (
            left.withColumn("qhash", F.xxhash64("weights"))
            .groupBy("grp", "shard")
            .cogroup(right.groupBy("grp", "shard"))
            .applyInPandas(task, "query_id bigint, qhash bigint, vec_id bigint, score bigint")
        )

    first = F.array((F.col("grp") % shards).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("grp") % shards)
    found = stored(scored(asked.withColumn("floor_score", F.lit(None).cast("bigint")), first), "first-round")
    if shards > 1:
        floors = (
            found.groupBy(F.col("query_id").alias("vec_id"), F.col("qhash").alias("own_hash"))
            .agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor_score"))
        )
        primed = asked.withColumn("own_hash", F.xxhash64("weights")).join(floors, ["vec_id", "own_hash"], "left")
        found = found.unionByName(scored(primed.drop("own_hash"), others))
    best = Window.partitionBy("query_id", "qhash").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.when(F.col("vec_id") != int(NO_ID), F.col("vec_id")).alias("vec_id"), "score")
    )


def op3_topk(spark, folder: str) -> DataFrame:
    vectors = documents(spark, folder, "embeddings").select("vec_id", term_weights(F.col("embedding")).alias("weights"))
    return top_k(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), 5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_inner_product(q.w::DOUBLE[], c.w::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

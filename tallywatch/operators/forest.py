"""Isolation forest: trees grown from bounded samples in parallel tasks, scored by Arrow batches.

A tree sees at most ``FOREST_ROWS_PER_TREE`` rows and is no deeper than the logarithm of that, so
one group, one tree and the whole forest have fixed size bounds that do not grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.operators.quality import uniform

NODE_SCHEMA = "tree_id int, node_id int, feature int, threshold double, lower int, upper int, path double"
SCORE_CHUNK = 20_000


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def tree_samples(
    features: DataFrame, total_rows: int, trees: int, rows_per_tree: int, seed: int
) -> tuple[DataFrame, int]:
    """Rows tagged with the tree they serve, and the sample size of a tree.

    Every tree draws from all rows. Membership is a hash of row and tree: a row is expanded only to the trees that take it. Six
    deviations more than needed are drawn on average, of which a tree keeps its lowest hashes.
    """
    fit = features.select("txn_id", *C.FEATURE_COLUMNS)
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    share = min(1.0, (rows_per_tree + 6 * math.sqrt(rows_per_tree)) / max(total_rows, 1))

    def draw(tree: Column) -> Column:
        return uniform(F.col("txn_id"), tree, F.lit(seed + 1))

    tagged = fit.withColumn("tree_id", F.explode(F.filter(every, lambda tree: draw(tree) < share)))
    order = Window.partitionBy("tree_id").orderBy(draw(F.col("tree_id")), "txn_id")
    kept = tagged.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= rows_per_tree)
    return kept.drop("_place"), min(rows_per_tree, total_rows)


def fit_forest(
    features: DataFrame,
    total_rows: int,
    trees: int = C.FOREST_TREES,
    rows_per_tree: int = C.FOREST_ROWS_PER_TREE,
    seed: int = C.SPLIT_SEED,
) -> tuple[DataFrame, int]:
    """The node table of the forest and the sample size of its trees."""
    samples, size = tree_samples(features, total_rows, trees, rows_per_tree, seed)
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    columns = list(C.FEATURE_COLUMNS)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree_id"].iloc[0])
        return grow_tree(pdf[columns].to_numpy(float), limit, np.random.default_rng([seed, tree])).assign(tree_id=tree)[
            [f.split()[0] for f in NODE_SCHEMA.split(", ")]
        ]

    return samples.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA), size


def grow_tree(x: np.ndarray, depth_limit: int, rng: np.random.Generator) -> pd.DataFrame:
    """Random splits until a node is single, constant or at the depth limit."""
    nodes: list[list] = []
    pending = [(np.arange(len(x)), 0, -1, False)]
    while pending:
        rows, depth, parent, is_upper = pending.pop()
        node = len(nodes)
        if parent >= 0:
            nodes[parent][4 if is_upper else 3] = node
        split = _random_split(x, rows, rng) if depth < depth_limit and len(rows) > 1 else None
        if split is None:
            nodes.append([node, -1, 0.0, node, node, depth + expected_path(len(rows))])
            continue
        feature, threshold = split
        nodes.append([node, feature, threshold, -1, -1, 0.0])
        low = x[rows, feature] <= threshold
        pending.append((rows[~low], depth + 1, node, True))
        pending.append((rows[low], depth + 1, node, False))
    return pd.DataFrame(nodes, columns=["node_id", "feature", "threshold", "lower", "upper", "path"])


def _random_split(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> tuple[int, float] | None:
    for feature in rng.permutation(x.shape[1]):
        values = x[rows, feature]
        low, high = values.min(), values.max()
        if low < high:
            threshold = rng.uniform(low, high)
            return int(feature), float(threshold if threshold < high else low)
    return None


@dataclass(frozen=True)
class Forest:
    """All trees as flat arrays; a leaf points to itself, so walking needs no branches."""

    feature: np.ndarray
    threshold: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    depth: int
    sample_size: int

    @staticmethod
    def from_nodes(nodes: DataFrame, sample_size: int) -> Forest:
        """Gathers the node table, which is at most trees x 2 x sample size rows by construction."""
        pdf = nodes.toPandas().sort_values(["tree_id", "node_id"], ignore_index=True)
        sizes = pdf.groupby("tree_id").size()
        starts = sizes.cumsum() - sizes
        offset = pdf["tree_id"].map(starts).to_numpy()
        leaf = pdf["feature"].to_numpy() < 0
        return Forest(
            feature=np.where(leaf, 0, pdf["feature"].to_numpy()).astype(np.int32),
            threshold=np.where(leaf, np.inf, pdf["threshold"].to_numpy()),
            lower=(pdf["lower"].to_numpy() + offset).astype(np.int32),
            upper=(pdf["upper"].to_numpy() + offset).astype(np.int32),
            path=pdf["path"].to_numpy(float),
            roots=starts.to_numpy().astype(np.int32),
            depth=max(1, math.ceil(math.log2(max(sample_size, 2)))),
            sample_size=sample_size,
        )

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        """-2^(-E[path]/c): lower means more anomalous."""
        scale = max(expected_path(self.sample_size), 1e-12)
        return np.concatenate(
            [self._chunk(x[i : i + SCORE_CHUNK], scale) for i in range(0, len(x), SCORE_CHUNK)] or [np.empty(0)]
        )

    @cached_property
    def _steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(records, paths, roots, bits of a feature) of nodes laid out anew with the children of a node side by side.
        A record is a threshold beside the lower child and the feature in one number: a step fetches one of them."""
        leaf = self.lower == np.arange(len(self.lower))
        inner = np.flatnonzero(~leaf)
        place = np.empty(len(leaf), np.int64)
        place[self.roots] = np.arange(len(self.roots))
        first = len(self.roots) + 2 * np.arange(len(inner))
        place[self.lower[inner]], place[self.upper[inner]] = first, first + 1
        below = np.arange(len(leaf))
        below[place[inner]] = first
        bits = int(self.feature.max(initial=0)).bit_length()
        records = np.empty(len(leaf), np.complex128)
        records.view(float)[2 * place] = np.where(leaf, np.inf, self.threshold)
        packed = below << bits
        packed[place] |= self.feature
        records.view(np.int64)[1::2] = packed
        paths = np.empty(len(leaf))
        paths[place] = self.path
        return records, paths, place[self.roots], bits

    def _chunk(self, x: np.ndarray, scale: float) -> np.ndarray:
        n = len(x)
        flat, rows = np.ascontiguousarray(x, float).ravel(), np.arange(n) * x.shape[1]
        records, paths, roots, bits = self._steps
        total, value, record = np.zeros(n), np.empty(n), np.empty(n, np.complex128)
        at, place, above = np.empty(n, np.intp), np.empty(n, np.intp), np.empty(n, bool)
        threshold, packed = record.view(float)[::2], record.view(np.int64)[1::2]
        for root in roots:  # one tree at a time stays in the cache
            at[:] = root
            for _ in range(self.depth):
                records.take(at, out=record, mode="clip")
                np.bitwise_and(packed, (1 << bits) - 1, out=place)
                place += rows
                flat.take(place, out=value, mode="clip")
                np.greater(value, threshold, out=above)
                np.right_shift(packed, bits, out=at)
                at += above
            total += paths.take(at)
        return -np.exp2(-total / len(self.roots) / scale)


def feature_batches(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[np.ndarray]:
    for columns in batches:
        yield np.column_stack([np.nan_to_num(c.to_numpy(dtype=float, na_value=0.0)) for c in columns])


def with_anomaly_raw(df: DataFrame, forest: Forest, out: str = "anomaly_raw") -> DataFrame:
    """Adds the raw anomaly score. Only the features travel to Python, the rest of a row stays put."""
    shared = _broadcast(df.sparkSession, forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = shared.value
        for x in feature_batches(batches):
            yield pd.Series(model.raw_scores(x))

    return df.withColumn(out, score(*(F.col(c).cast("double") for c in C.FEATURE_COLUMNS)))


def _broadcast(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)

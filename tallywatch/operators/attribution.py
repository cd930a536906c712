"""Per-row attributions of the boosted trees: exact Shapley values along the tree paths.

A tree is cut into subtrees so small that the contributions of all their leaves fit one table over the cells of
their conditions; the tables are made once on the driver and depend on the model only. A row then needs one bin
lookup per feature and, per subtree, one step per feature to its cell and one lookup there. The sum of a row's
attributions and the base value is its log-odds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.operators.forest import feature_batches
from tallywatch.operators.hybrid import top_attributions

CHUNK_ROWS = 4096
MOST_CELLS = 1024  # of a subtree with more than one leaf

Condition = tuple[float, float, float]
Leaf = tuple[float, dict[int, Condition]]


@dataclass(frozen=True)
class Block:
    """The leaves of one subtree: what they contribute to each feature they test, per cell.

    ``steps`` turns the bins of a feature into its part of the cell's number.
    """

    features: tuple[int, ...]
    steps: tuple[np.ndarray, ...]
    values: tuple[np.ndarray, ...]


@dataclass(frozen=True)
class LeafTables:
    """Tabulated contributions of all features, and the bin edges of those that are used."""

    edges: dict[int, np.ndarray]
    blocks: list[Block]
    width: int
    base: float

    def explain(self, x: np.ndarray) -> np.ndarray:
        """Attributions in log-odds, one column per feature."""
        out = np.zeros((self.width, len(x)))
        for i in range(0, len(x), CHUNK_ROWS):
            part = x[i : i + CHUNK_ROWS]
            bins = {f: np.searchsorted(edges, part[:, f], side="left") for f, edges in self.edges.items()}
            total, cell, step, found = np.zeros((self.width, len(part))), *np.empty((2, len(part)), np.intp), np.empty(len(part))
            # Subtree by subtree, so that its small tables stay in cache for all rows; every index is in range.
            for block in self.blocks:
                cell[:] = 0
                for f, steps in zip(block.features, block.steps):
                    cell += steps.take(bins[f], out=step, mode="clip")
                for f, values in zip(block.features, block.values):
                    total[f] += values.take(cell, out=found, mode="clip")
            out[:, i : i + CHUNK_ROWS] = total
        return np.ascontiguousarray(out.T)


def leaf_conditions(nodes: pd.DataFrame, most_cells: int = MOST_CELLS) -> list[list[Leaf]]:
    """(value, {feature: (above, up to, share of cover)}) of every leaf of one tree, by subtrees of at most
    ``most_cells`` cells."""
    table = {n.node_id: n for n in nodes.itertuples()}

    def below(node_id: int, path: dict[int, Condition]) -> list[list[Leaf]]:
        node = table[node_id]
        if node.feature < 0:
            return [[(node.value, path)]]
        out = []
        for child, is_lower in ((node.lower, True), (node.upper, False)):
            above, upto, share = path.get(node.feature, (-math.inf, math.inf, 1.0))
            bounds = (above, min(upto, node.threshold)) if is_lower else (max(above, node.threshold), upto)
            out += below(child, {**path, node.feature: (*bounds, share * table[child].cover / node.cover)})
        # What could not be joined further down cannot be joined here either.
        whole = [leaf for part in out for leaf in part]
        return [whole] if len(out) == 2 and cells_of(whole) <= most_cells else out

    return below(0, {})


def cuts_of(leaves: list[Leaf]) -> dict[int, np.ndarray]:
    """The finite bounds of all conditions, by feature."""
    cuts: dict[int, set] = {}
    for _, path in leaves:
        for feature, (above, upto, _) in path.items():
            cuts.setdefault(int(feature), set()).update(b for b in (above, upto) if math.isfinite(b))
    return {f: np.array(sorted(found)) for f, found in cuts.items()}


def cells_of(leaves: list[Leaf]) -> int:
    return math.prod(len(cuts) + 1 for cuts in cuts_of(leaves).values())


def pattern_values(share: np.ndarray, leaf_value: np.ndarray) -> np.ndarray:
    """Shapley values for leaves with m conditions each: shape (leaves, 2^m patterns, m).

    ``share`` is (leaves, m). A condition that holds passes 1, one left to chance passes its share
    of cover. Weights are those of subset sizes, summed by polynomial products.
    """
    leaves, m = share.shape
    holds = ((np.arange(2**m)[:, None] >> np.arange(m)) & 1).astype(float)
    weight = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
    result = np.empty((leaves, 2**m, m))
    for j in range(m):
        poly = np.zeros((leaves, 2**m, m))
        poly[:, :, 0] = 1.0
        for k in range(m):
            if k != j:
                grown = poly * share[:, k, None, None]
                grown[:, :, 1:] += poly[:, :, :-1] * holds[None, :, k, None]
                poly = grown
        result[:, :, j] = (poly * weight).sum(axis=2) * (holds[None, :, j] - share[:, j, None])
    return result * leaf_value[:, None, None]


def block_of(leaves: list[tuple[dict[int, Condition], np.ndarray]], edges: dict[int, np.ndarray]) -> Block:
    """The table of leaves with their conditions and pattern values. Cells are numbered over the bins of each feature
    as far as the leaves tell them apart."""
    cuts = cuts_of([(0.0, path) for path, _ in leaves])
    sizes = [len(c) + 1 for c in cuts.values()]
    strides = [math.prod(sizes[i + 1 :]) for i in range(len(sizes))]
    # Bin b holds values in (cuts[b-1], cuts[b]]; its upper edge stands for all of them.
    upper = [np.append(c, np.inf) for c in cuts.values()]
    place = {f: i for i, f in enumerate(cuts)}
    values = np.zeros((len(sizes), *sizes))
    for path, found in leaves:
        pattern = np.zeros([1] * len(sizes), np.intp)
        for slot, (f, (above, upto, _)) in enumerate(path.items()):
            holds = (upper[place[f]] > above) & (upper[place[f]] <= upto)
            pattern = pattern | (holds.astype(np.intp) << slot).reshape([-1 if i == place[f] else 1 for i in range(len(sizes))])
        for slot, f in enumerate(path):
            values[place[f]] += found[:, slot].take(pattern)
    steps = [np.searchsorted(c, np.append(edges[f], np.inf), side="left") * stride for (f, c), stride in zip(cuts.items(), strides)]
    return Block(tuple(cuts), tuple(s.astype(np.intp) for s in steps), tuple(v.ravel() for v in values))


def build_tables(tree_table: DataFrame, features: int = len(C.FEATURE_COLUMNS), most_cells: int = MOST_CELLS) -> LeafTables:
    """Tables of a classifier's node table, which is bounded by rounds x 2^(depth+1) rows."""
    nodes = tree_table.toPandas()
    subtrees = [subtree for _, tree in nodes.groupby("tree_id") for subtree in leaf_conditions(tree, most_cells)]
    leaves = [leaf for subtree in subtrees for leaf in subtree]
    base = sum(value * math.prod(c[2] for c in path.values()) for value, path in leaves)

    by_length: dict[int, list[int]] = {}
    for i, (_, path) in enumerate(leaves):
        if path:
            by_length.setdefault(len(path), []).append(i)
    values: dict[int, np.ndarray] = {}
    for members in by_length.values():
        share = np.array([[c[2] for c in leaves[i][1].values()] for i in members])
        values.update(zip(members, pattern_values(share, np.array([leaves[i][0] for i in members]))))

    edges, blocks, first = cuts_of(leaves), [], 0
    for subtree in subtrees:
        if subtree[0][1]:  # a tree that is one leaf has no conditions
            blocks.append(block_of([(path, values[first + i]) for i, (_, path) in enumerate(subtree)], edges))
        first += len(subtree)
    return LeafTables(edges, blocks, features, float(base))


def with_impacts(df: DataFrame, tables: LeafTables, out: str = "impacts") -> DataFrame:
    """Adds the attributions of all features as one array in feature order."""
    shared = df.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = shared.value
        for x in feature_batches(batches):
            yield pd.Series(list(model.explain(x)))

    # Said to be nondeterministic, so that no filter made of the attributions is moved below and explains rows again.
    rated = explain.asNondeterministic()(*(F.col(c).cast("double") for c in C.FEATURE_COLUMNS))
    return df.withColumn(out, rated)


def with_attributions(df: DataFrame, tables: LeafTables, n: int = C.TOP_ATTRIBUTIONS) -> DataFrame:
    """Adds the n strongest attributions of each row as (feature, label, impact)."""
    impacts = {name: F.col("impacts")[i] for i, name in enumerate(C.FEATURE_COLUMNS)}
    return with_impacts(df, tables).withColumn("attributions", top_attributions(impacts, n)).drop("impacts")

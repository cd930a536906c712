"""The boosted-tree classifier: second-order gradient boosting on histograms of bin codes.

Features become one-byte bin codes once, by a mergeable quantile sketch, and are stored as packed
blocks. A tree grows from the sums of gradients and Hessians per (node, feature, bin): every task adds
up its rows, a shuffle by node adds the tasks' histograms (the driver does while they are few; their size depends on
bins and nodes alone) and the driver picks the splits of a level. Rows never move: a level is one pass of a task per core. At
most ``BOOST_LOCAL_ROWS`` rows are one task, which grows a tree by the same two functions, so
where a tree is grown changes nothing in it. Sums are of whole numbers (gradients in units of a
power of two), so they are exact, and the model does not depend on how rows are laid out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.operators.forest import feature_batches
from tallywatch.operators.quality import uniform
from tallywatch.session import ensure_checkpoint_dir

NODE_SCHEMA = (
    "tree_id int, node_id int, feature int, threshold double, lower int, upper int, "
    "value double, gain double, gradient double, cover double"
)
PENALTY = 1.0  # on squared leaf values
LEAST_HESSIAN = 1.0  # in a child
LEAST_GAIN = 1e-6
CHUNK = 16_384  # rows whose arrays stay in the cache
MOST_COLLECTED = 32  # histograms of one node that the driver adds up itself
EXACT = 52  # bits of a whole number that a double holds, less one
LEAF_BITS = 6  # levels of a tree whose leaves have a bit each


def first_left(masks: dict[int, np.ndarray], bins: Sequence[np.ndarray]) -> np.ndarray:
    """The place of the lowest bit that no feature's bin rules out, per row."""
    left = np.full(len(bins[0]), ~np.uint64(0))
    mask = np.empty_like(left)
    for feature, by_bin in masks.items():
        left &= by_bin.take(bins[feature], out=mask, mode="clip")
    left &= np.negative(left, out=mask)
    return (left.astype(float).view(np.int64) >> 52) - 1023  # the exponent of a power of two


@dataclass(frozen=True)
class Bins:
    """Upper edges of every feature's bins; a value above the last edge has a bin of its own."""

    edges: tuple[np.ndarray, ...]

    @property
    def starts(self) -> np.ndarray:
        """Where each feature's bins start in a histogram, with the total at last."""
        return np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One row of byte codes per feature."""
        return np.stack([np.searchsorted(e, x[:, f], side="left").astype(np.uint8) for f, e in enumerate(self.edges)])


@dataclass
class Tree:
    """Nodes by their place in a full binary tree: the children of i are 2 i + 1 and 2 i + 2."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    gradient: np.ndarray = field(init=False)
    hessian: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.full(size, -1, np.int16)
        self.bin = np.zeros(size, np.int16)
        self.value, self.gain, self.gradient, self.hessian = (np.zeros(size) for _ in range(4))

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The node in which every row ends."""
        return self.placer()(codes)

    def placer(self) -> Callable[[np.ndarray], np.ndarray]:
        """``place`` for many blocks of rows. A split that a row does not pass rules out the leaves below it; of the
        leaves that are left the first is the row's. Deeper trees are walked."""
        if self.depth > LEAF_BITS:
            return self._walked
        masks, leaves = self._masks()
        return lambda codes: leaves.take(first_left(masks, codes), mode="clip")

    def _walked(self, codes: np.ndarray) -> np.ndarray:
        rows = np.arange(codes.shape[1])
        at = np.zeros(len(rows), np.int32)
        for _ in range(self.depth):
            feature = self.feature[at]
            above = codes[np.maximum(feature, 0), rows] > self.bin[at]
            at = np.where(feature < 0, at, 2 * at + 1 + above)
        return at

    def _masks(self) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """Per feature and code the leaves that are not ruled out, and the leaves from left to right."""
        masks: dict[int, np.ndarray] = {}
        leaves: list[int] = []

        def below(node: int) -> None:
            feature = int(self.feature[node])
            if feature < 0:
                leaves.append(node)
                return
            start = len(leaves)
            below(2 * node + 1)
            ruled_out = np.uint64((1 << len(leaves)) - (1 << start))
            masks.setdefault(feature, np.full(256, ~np.uint64(0)))[self.bin[node] + 1 :] &= ~ruled_out
            below(2 * node + 2)

        below(0)
        return masks, np.array(leaves, np.intp)

    def split(self, node: int, found: tuple) -> None:
        feature, at, gain, gradient, hessian = found
        self.feature[node], self.bin[node], self.gain[node] = feature, at, gain
        self.gradient[2 * node + 1], self.hessian[2 * node + 1] = gradient, hessian
        self.gradient[2 * node + 2] = self.gradient[node] - gradient
        self.hessian[2 * node + 2] = self.hessian[node] - hessian


def histogram(codes: np.ndarray, slot: np.ndarray, slots: int, sums: Sequence[np.ndarray | None], starts: np.ndarray) -> np.ndarray:
    """Shape (slots, bins of all features, sums): the sums of the rows of every slot and bin, their number
    for None; a row with a negative slot counts nowhere."""
    inside = np.flatnonzero(slot >= 0)
    if len(inside) < len(slot):
        codes, slot = codes.take(inside, axis=1), slot.take(inside)
        sums = [s if s is None else s.take(inside) for s in sums]
    out = np.zeros((slots, starts[-1], len(sums)))
    first, key = slot.astype(np.intp) * 256, np.empty(len(slot), np.intp)
    for f, (low, high) in enumerate(zip(starts, starts[1:])):
        np.add(first, codes[f], out=key)
        for k, values in enumerate(sums):
            out[:, low:high, k] = np.bincount(key, values, slots * 256).reshape(slots, 256)[:, : high - low]
    return out


def best_splits(found: np.ndarray, starts: np.ndarray) -> list[tuple | None]:
    """Per slot of a histogram in true units the (feature, bin, gain, gradient and Hessian below) of the
    split with the highest gain, the first of equal ones; None where no split gains."""
    out: list[tuple | None] = []
    gains = np.full(found.shape[:2], -np.inf)
    below = np.empty(found.shape[:2] + (2,))
    total = found[:, starts[0] : starts[1], :2].sum(axis=1)
    for low, high in zip(starts, starts[1:]):
        left = np.cumsum(found[:, low:high, :2], axis=1)
        below[:, low:high] = left
        g, h = left[..., 0], left[..., 1]
        rest_g, rest_h = total[:, :1] - g, total[:, 1:] - h
        gain = g * g / (h + PENALTY) + rest_g * rest_g / (rest_h + PENALTY) - (total[:, 0] * total[:, 0] / (total[:, 1] + PENALTY))[:, None]
        gains[:, low:high] = np.where((h >= LEAST_HESSIAN) & (rest_h >= LEAST_HESSIAN), gain, -np.inf)
    for slot, at in enumerate(gains.argmax(axis=1)):
        if gains[slot, at] <= LEAST_GAIN:
            out.append(None)
            continue
        feature = int(np.searchsorted(starts, at, side="right") - 1)
        out.append((feature, int(at - starts[feature]), float(gains[slot, at]), *below[slot, at].tolist()))
    return out


@dataclass(frozen=True)
class Loss:
    """Log loss with a weight per class, its derivatives as whole numbers of ``unit``."""

    weights: tuple[float, float]  # of label 0 and label 1
    unit: float

    @staticmethod
    def of(weights: tuple[float, float], rows: tuple[int, int]) -> Loss:
        total = max(2.0, weights[0] * rows[0] + weights[1] * rows[1])
        return Loss(weights, 2.0 ** (math.ceil(math.log2(total)) - EXACT))

    def sums(self, margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        weight = np.where(label == 1, self.weights[1], self.weights[0])
        return np.rint(weight * (p - label) / self.unit), np.rint(weight * p * (1 - p) / self.unit)


@dataclass(frozen=True)
class Part:
    """Rows of one partition, and their margins by the trees so far."""

    codes: np.ndarray
    label: np.ndarray
    margin: np.ndarray

    def chunks(self, trees: Sequence[Tree]) -> Iterator[Part]:
        """The rows a chunk at a time with codes as indices, and margins by ``trees`` too."""
        added = [(tree.placer(), tree.value) for tree in trees]
        for i in range(0, len(self.label), CHUNK):
            codes, margin = self.codes[:, i : i + CHUNK].astype(np.intp), self.margin[i : i + CHUNK]
            for place, value in added:
                margin = margin + value.take(place(codes))
            yield Part(codes, self.label[i : i + CHUNK], margin)

    def after(self, trees: Sequence[Tree]) -> Part:
        return Part(self.codes, self.label, np.concatenate([part.margin for part in self.chunks(trees)]))


def finish(codes: np.ndarray, g: np.ndarray, h: np.ndarray, root: int, depth: int, loss: Loss, starts: np.ndarray) -> list[tuple]:
    """(node, split) of the subtree of ``root``, grown from all of its rows down to ``depth``."""
    out, at, codes = [], np.full(codes.shape[1], root), codes.astype(np.intp)
    found = histogram(codes, np.zeros(codes.shape[1], np.int64), 1, (g, h), starts)
    open_nodes = [root]
    while open_nodes and open_nodes[0] < 2**depth - 1:
        parents = {}
        for node, split, sums in zip(open_nodes, best_splits(found * loss.unit, starts), found):
            if split:
                out.append((node, split))
                here = np.flatnonzero(at == node)
                at[here] = 2 * node + 1 + (codes[split[0], here] > split[1])
                parents[node] = sums
        open_nodes = [child for node in parents for child in (2 * node + 1, 2 * node + 2)]
        if not open_nodes or open_nodes[0] >= 2**depth - 1:
            break
        # The smaller child of every pair is added up, the other is what is left of the parent.
        rows = np.bincount(at, minlength=2 * max(parents) + 3)
        smaller = [2 * node + 1 + int(rows[2 * node + 2] < rows[2 * node + 1]) for node in parents]
        slot_of = np.full(len(rows), -1)
        slot_of[smaller] = np.arange(len(smaller))
        added = histogram(codes, slot_of[at], len(smaller), (g, h), starts)
        found = np.stack([s for child, sums, own in zip(smaller, parents.values(), added) for s in ((own, sums - own) if child % 2 else (sums - own, own))])
    return out


class Grower:
    """Grows trees over parts that stay cached; margins are brought up to date every few trees."""

    def __init__(self, parts: RDD, rows: int, bins: Bins, loss: Loss, depth: int, rate: float, local_rows: int):
        self.bins, self.loss, self.depth, self.rate = bins, loss, depth, rate
        self.rows, self.local_rows = rows, local_rows
        self.parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
        self.recent: list[Tree] = []
        self.grown = 0

    def tree(self) -> Tree:
        tree, starts = Tree(self.depth), self.bins.starts
        if self.rows <= self.local_rows:
            (tree.gradient[0], tree.hessian[0]), splits = self._whole()
            for node, split in splits:
                tree.split(node, split)
        else:
            self._by_levels(tree, starts)
        leaf = tree.feature < 0
        tree.value = np.where(leaf, -self.rate * tree.gradient / (tree.hessian + PENALTY), 0.0)
        self._note(tree)
        return tree

    def _by_levels(self, tree: Tree, starts: np.ndarray) -> None:
        found, open_nodes = self._histograms(tree, [0]), [0]
        tree.gradient[0], tree.hessian[0] = found[0, : starts[1], :2].sum(axis=0)
        while open_nodes:
            parents, wanted = {}, []
            for node, split, sums in zip(open_nodes, best_splits(found, starts), found):
                if not split:
                    continue
                tree.split(node, split)
                if 2 * node + 1 < 2**self.depth - 1:
                    parents[node] = sums
                    below = sums[starts[split[0]] : starts[split[0]] + split[1] + 1, 2].sum()
                    wanted.append(2 * node + 1 + int(2 * below > sums[: starts[1], 2].sum()))
            if not wanted:
                return
            # The smaller child of every pair is added up, the other is what is left of the parent.
            added = zip(wanted, parents.values(), self._histograms(tree, wanted))
            found = np.stack([s for child, sums, own in added for s in ((own, sums - own) if child % 2 else (sums - own, own))])
            open_nodes = [child for node in parents for child in (2 * node + 1, 2 * node + 2)]

    def _histograms(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        """Gradient, Hessian and number of rows per node and bin, over all rows."""
        recent, loss, starts = self.recent, self.loss, self.bins.starts
        slot_of = np.full(len(tree.feature), -1)
        slot_of[nodes] = np.arange(len(nodes))

        def add(parts: Iterator[Part]) -> Iterator[np.ndarray]:
            place = tree.placer()
            found = np.zeros((len(nodes), starts[-1], 3))
            for part in parts:
                for rows in part.chunks(recent):
                    sums = (*loss.sums(rows.margin, rows.label), None)
                    found += histogram(rows.codes, slot_of.take(place(rows.codes)), len(nodes), sums, starts)
            yield found

        tasks = self.parts.getNumPartitions()
        added = self.parts.mapPartitions(add)
        if tasks * len(nodes) <= MOST_COLLECTED:
            found = sum(added.collect())
        else:  # the tasks' histograms are added before the driver, which gets one per node
            by_node = added.flatMap(lambda whole: list(enumerate(whole))).reduceByKey(np.add, min(len(nodes), tasks))
            found = np.stack([h for _, h in sorted(by_node.collect(), key=lambda pair: pair[0])])
        return found * np.array([loss.unit, loss.unit, 1.0])

    def _whole(self) -> tuple[tuple[float, float], list[tuple]]:
        """The sums of the root and the splits of a tree whose rows are all in one task."""
        recent, loss, starts, depth = self.recent, self.loss, self.bins.starts, self.depth

        def grow(parts: Iterator[Part]) -> Iterator[tuple]:
            for part in parts:
                part = part.after(recent)
                g, h = loss.sums(part.margin, part.label)
                yield (float(g.sum() * loss.unit), float(h.sum() * loss.unit)), finish(part.codes, g, h, 0, depth, loss, starts)

        return self.parts.mapPartitions(grow).collect()[0]

    def _note(self, tree: Tree) -> None:
        self.recent.append(tree)
        self.grown += 1
        if len(self.recent) == C.BOOST_REFRESH:
            recent, before = self.recent, self.parts
            self.parts = before.map(lambda part: part.after(recent)).persist(StorageLevel.MEMORY_AND_DISK)
            if self.grown % C.BOOST_CHECKPOINT == 0:
                self.parts.checkpoint()
            self.parts.count()
            before.unpersist()
            self.recent = []

    def close(self) -> None:
        self.parts.unpersist()


def bin_edges(rows: DataFrame, bins: int = C.BOOST_BINS) -> Bins:
    """Distinct approximate quantiles of every feature, from one pass."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = rows.agg(*(F.percentile_approx(F.col(c), shares, 20 * bins).alias(c) for c in C.FEATURE_COLUMNS)).first()
    return Bins(tuple(np.unique(np.array(found[c] or [], float)) for c in C.FEATURE_COLUMNS))


def _filled(features: DataFrame) -> list:
    """The features as doubles, absent values as 0."""
    return [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in C.FEATURE_COLUMNS]


def packed_blocks(rows: DataFrame, bins: Bins) -> DataFrame:
    """Blocks of rows as byte codes and labels, from the features and label."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in C.FEATURE_COLUMNS])
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bins.codes(x).tobytes()], pa.binary()), pa.array([label.tobytes()], pa.binary())], names=["codes", "label"]
            )

    return rows.select(*_filled(rows), "label").mapInArrow(pack, "codes binary, label binary")


def tasks_of(rows: int, local_rows: int, cores: int) -> int:
    """One where a task holds all rows. Else a task per core, so that a level is one wave, as long as a task has about a
    quarter of ``local_rows`` to four times as many. More rows are one or two waves of larger tasks, up to 32 times as
    many rows a task, and beyond that as many waves as they need."""
    if rows <= local_rows:
        return 1
    least = -(-rows // (4 * local_rows))
    if least <= cores:
        return max(2, least, min(cores, 4 * rows // local_rows))
    return max(2, cores * max(min(least // cores, 2), -(-rows // (32 * local_rows * cores))))


def parts_of(blocks: DataFrame, tasks: int, base: float, local_rows: int = C.BOOST_LOCAL_ROWS) -> RDD:
    """The blocks of a partition as a ``Part`` per four times ``local_rows`` rows, of which a task holds one at a time."""

    def part(blocks: list[tuple[np.ndarray, np.ndarray]]) -> Part:
        label = np.concatenate([label for _, label in blocks])
        return Part(np.concatenate([codes for codes, _ in blocks], axis=1), label, np.full(len(label), base))

    def merge(rows: Iterator) -> Iterator[Part]:
        held, size = [], 0
        for row in rows:
            label = np.frombuffer(row["label"], np.uint8)
            if held and size + len(label) > 4 * local_rows:
                yield part(held)
                held, size = [], 0
            held.append((np.frombuffer(row["codes"], np.uint8).reshape(-1, len(label)), label))
            size += len(label)
        if held:
            yield part(held)

    return blocks.repartition(tasks).rdd.mapPartitions(merge)


def node_rows(trees: Sequence[Tree], bins: Bins, base: float) -> list[tuple]:
    """The rows of the node table. Tree 0 is the base: one leaf with the prior log-odds."""
    rows = [(0, 0, -1, None, -1, -1, base, 0.0, 0.0, 1.0)]
    for number, tree in enumerate(trees, 1):
        live = [0]
        for node in live:
            f = int(tree.feature[node])
            sums = [float(a[node]) for a in (tree.value, tree.gain, tree.gradient, tree.hessian)]
            if f < 0:
                rows.append((number, node, -1, None, -1, -1, *sums))
                continue
            live += [2 * node + 1, 2 * node + 2]
            rows.append((number, node, f, float(bins.edges[f][tree.bin[node]]), 2 * node + 1, 2 * node + 2, *sums))
    return rows


def boost(
    rows: DataFrame,
    folder: str,
    weights: tuple[float, float],
    counts: tuple[int, int],
    rounds: int,
    depth: int,
    rate: float,
    base: float = 0.0,
    bins: Bins | None = None,
    local_rows: int = C.BOOST_LOCAL_ROWS,
) -> DataFrame:
    """The node table of trees on rows with the features and label; ``counts`` and ``weights`` are of
    labels 0 and 1. Blocks are stored in ``folder``."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    bins = bins or bin_edges(rows)
    packed_blocks(rows, bins).write.parquet(folder)
    blocks = spark.read.schema("codes binary, label binary").parquet(folder)
    n = blocks.agg(F.coalesce(F.sum(F.octet_length("label")), F.lit(0))).first()[0]
    loss = Loss.of(weights, counts)
    parts = parts_of(blocks, tasks_of(n, local_rows, spark.sparkContext.defaultParallelism), base, local_rows)
    grower = Grower(parts, n, bins, loss, depth, rate, local_rows)
    trees = [grower.tree() for _ in range(rounds)] if n else []
    grower.close()
    return spark.createDataFrame(node_rows(trees, bins, base), NODE_SCHEMA)


def fit_classifier(
    features: DataFrame,
    counts: tuple[int, int],
    folder: str,
    weighted: bool = True,
    rounds: int = C.BOOST_ROUNDS,
    depth: int = C.BOOST_DEPTH,
    rate: float = C.BOOST_RATE,
    most_rows: int | None = None,
) -> DataFrame:
    """The node table of a classifier of rows with ``label``, of which there are ``counts`` (positive,
    negative).

    Positives weigh as much as negatives together when ``weighted``. The classifier is fitted on all rows.
    Only a caller that gives ``most_rows`` has it fitted on at most about that many: of a class with more than
    half of that, rows are drawn by hash, and each stands for as many as were left out.
    """
    positives, negatives = counts
    shares = [min(1.0, most_rows / 2 / n) if most_rows and n else 1.0 for n in counts]
    worth = negatives / positives if weighted and positives else 1.0
    weights = (1.0 / shares[1], worth / shares[0])
    if min(shares) < 1:
        share = F.when(F.col("label") == 1, shares[0]).otherwise(shares[1])
        features = features.filter(uniform(F.col("txn_id"), F.lit(C.SPLIT_SEED + 2)) < share)
    mean = worth * positives / max(worth * positives + negatives, 1)
    base = math.log(mean / (1 - mean)) if 0 < mean < 1 else 0.0
    kept = (round(negatives * shares[1]) + 1, round(positives * shares[0]) + 1)
    return boost(features, folder, weights, kept, rounds, depth, rate, base)


def leaf_masks(tree: pd.DataFrame, edges: Sequence[np.ndarray]) -> tuple[dict[int, np.ndarray], np.ndarray] | None:
    """Per feature and bin the leaves of a tree that are not ruled out, and their values from left to right; None for
    more leaves than bits."""
    if (tree["feature"] < 0).sum() > 2**LEAF_BITS:
        return None
    table = {n.node_id: n for n in tree.itertuples()}
    masks: dict[int, np.ndarray] = {}
    values: list[float] = []

    def below(node_id: int) -> None:
        node = table[node_id]
        if node.feature < 0:
            values.append(node.value)
            return
        start = len(values)
        below(node.lower)
        mask = masks.setdefault(node.feature, np.full(len(edges[node.feature]) + 1, ~np.uint64(0)))
        mask[np.searchsorted(edges[node.feature], node.threshold) + 1 :] &= ~np.uint64((1 << len(values)) - (1 << start))
        below(node.upper)

    below(0)
    return masks, np.array(values)


@dataclass(frozen=True)
class Booster:
    """All trees as flat arrays; a leaf points to itself, so walking needs no branches. Where a tree has a bit for
    every leaf, rows go by what the bins between the thresholds rule out instead."""

    feature: np.ndarray
    threshold: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    edges: list[np.ndarray]  # the thresholds of every feature
    masks: list[tuple[dict[int, np.ndarray], np.ndarray] | None]  # of every tree

    @staticmethod
    def from_nodes(nodes: DataFrame) -> Booster:
        """Gathers a node table, which has at most rounds x 2^(depth + 1) rows."""
        pdf = nodes.toPandas().sort_values(["tree_id", "node_id"], ignore_index=True)
        place = {key: i for i, key in enumerate(zip(pdf["tree_id"], pdf["node_id"]))}
        leaf = pdf["feature"].to_numpy() < 0

        def child(side: str) -> np.ndarray:
            keys = zip(pdf["tree_id"], pdf[side], leaf)
            return np.array([i if is_leaf else place[t, n] for i, (t, n, is_leaf) in enumerate(keys)], np.int32)

        inner = pdf[~leaf]
        edges = [np.unique(inner["threshold"].to_numpy(float)[inner["feature"] == f]) for f in range(len(C.FEATURE_COLUMNS))]
        return Booster(
            feature=np.where(leaf, 0, pdf["feature"].to_numpy()).astype(np.int32),
            threshold=np.where(leaf, np.inf, pdf["threshold"].to_numpy(float)),
            lower=child("lower"),
            upper=child("upper"),
            value=pdf["value"].to_numpy(float),
            roots=np.flatnonzero(pdf["node_id"].to_numpy() == 0).astype(np.int32),
            depth=int(np.log2(pdf["node_id"].max() + 1)),
            edges=edges,
            masks=[leaf_masks(tree, edges) for _, tree in pdf.groupby("tree_id")],
        )

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        chunks = [self._chunk(x[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]
        return np.concatenate(chunks or [np.empty(0)])

    def _chunk(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.zeros(len(x))
        bins = [np.searchsorted(edges, x[:, f], side="left") for f, edges in enumerate(self.edges)]
        for root, masks in zip(self.roots, self.masks):  # one tree at a time stays in the cache
            if masks:
                total += masks[1].take(first_left(masks[0], bins), mode="clip")
                continue
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.lower[at], self.upper[at])
            total += self.value[at]
        return total


def with_probability(df: DataFrame, model: Booster, out: str = "probability") -> DataFrame:
    """Adds the probability of class 1 and the class predicted from it. Only the features travel to Python."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def margin(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = shared.value
        for x in feature_batches(batches):
            yield pd.Series(trees.margins(x))

    kept = [c for c in df.columns if c not in (out, "prediction")]
    rated = df.select(*kept, margin(*(F.col(c).cast("double") for c in C.FEATURE_COLUMNS)).alias("_margin"))
    probability = 1 / (1 + F.exp(-F.col("_margin")))
    return rated.select(*kept, probability.alias(out), (F.col("_margin") > 0).cast("int").alias("prediction"))


def load_classifier(spark: SparkSession, path: str) -> Booster:
    return Booster.from_nodes(spark.read.parquet(path))

"""A Merkle manifest of a dataset as a persistent tree with path copying.

Every row is a leaf, the digest of its columns. The leaves of a source, in the order of their ids,
form a tree in which 16 consecutive nodes have one parent; the roots of the sources form another one
in the same way, whose root stands for the dataset. A changed row makes a *version* of the tree:
its leaf's ancestors are copied with new digests and every other node is shared with the tree as it
was. Within an aligned block of ``BLOCK`` leaves the tree is an object whose nodes are never
altered, so a version there is one new node per level; above the block the version goes on along the
stored path of the block, one level after the other, up to a root of its own.

On Spark a tree grows block by block: positions come from one range sort, a group is a block and
therefore bounded, and a round of blocks leaves one node of ``BLOCK``. The nodes of all rounds are
stored; on the way down each block gets the path above it, left and right siblings per level.

Defined results: a null column is hashed as '-', a null source is a tree of its own and the first;
a null id comes first in its source and is never tampered with; rows with equal ids are ordered by
their leaves, and equal leaves may change places without any digest changing; a source with one row
has its leaf as root; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.llm.common import documents, lower_ascii, stored

FAN = 16
BLOCK_LEVELS = 2
BLOCK = FAN**BLOCK_LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
SHA = pa.string()
SIDES = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@dataclass(frozen=True, slots=True)
class Node:
    """A node is never altered; versions share what they did not copy."""

    digest: str
    children: tuple[Node, ...] = ()


def tree_of(leaves: list[str], levels: int) -> Node:
    nodes = [Node(leaf) for leaf in leaves]
    for _ in range(levels):
        runs = (tuple(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN))
        nodes = [Node(digest(n.digest for n in run), run) for run in runs]
    return nodes[0]


def with_leaf(root: Node, at: int, levels: int, leaf: str) -> list[Node]:
    """The copied nodes of the version with ``leaf`` at ``at``, from the leaf up to the new root."""
    if not levels:
        return [Node(leaf)]
    span = FAN ** (levels - 1)
    slot = at // span
    below = with_leaf(root.children[slot], at % span, levels - 1, leaf)
    children = (*root.children[:slot], below[-1], *root.children[slot + 1 :])
    return [*below, Node(digest(n.digest for n in children), children)]


def siblings(root: Node, at: int, levels: int) -> list[tuple[str, str]]:
    """Digests left and right of the path to ``at`` as they are joined, from the leaf's level upwards."""
    out = []
    for level in range(levels, 0, -1):
        slot, at = divmod(at, FAN ** (level - 1))
        run = [n.digest for n in root.children]
        out.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        root = root.children[slot]
    return out[::-1]


def levels_of(total: int) -> int:
    """Levels of a block in a tree with ``total`` nodes; a tree that fits the block ends at its root."""
    levels = 0
    while total > 1 and levels < BLOCK_LEVELS:
        total, levels = -(-total // FAN), levels + 1
    return levels


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """doc_id, tree, leaf and changed: the leaf of every row, and where ``tampered`` the one with ``text``."""

    def leaf(of_text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*(field(of_text if c == "text" else F.col(c)) for c in COLUMNS)), 256))

    changed = F.lit(None).cast("binary") if tampered is None else F.when(tampered, leaf(text))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # a null source sorts first
    return docs.select("doc_id", tree.alias("tree"), leaf(F.col("text")).alias("leaf"), changed.alias("changed"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds pos, the position of a row within its tree, and total, the rows of the tree.

    Rows are sorted by range, so a tree with a third of all rows lies in many partitions, and so do
    equal rows, which the last sort key tells apart. The window has a row per tree and partition.
    """
    ranked = rows.withColumn("_row", F.monotonically_increasing_id()).orderBy("tree", *order, "_row")
    ranked = stored(ranked.withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    ranked = ranked.withColumn("_part", F.shiftright("_at", 33))
    found = ranked.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select(
        "tree",
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(tree).alias("total"),
    )
    placed = ranked.join(found, ["tree", "_part"])
    return placed.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "total")


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).alias("block")


def _ordered(table: pa.Table) -> tuple[pa.Table, Node, int]:
    """The rows of a block in their order, its tree and the tree's levels."""
    table = table.sort_by("pos")
    levels = levels_of(table.column("total")[0].as_py())
    return table, tree_of([d.hex() for d in table.column("leaf").to_pylist()], levels), levels


def _parent(table: pa.Table) -> pa.Table:
    table, root, _ = _ordered(table)
    blocks = -(-table.column("total")[0].as_py() // BLOCK)
    place = table.column("pos")[0].as_py() // BLOCK
    return pa.table(
        {"tree": table.column("tree")[:1], "pos": [place], "total": [blocks], "leaf": pa.array([bytes.fromhex(root.digest)])}
    )


def rounds(placed: DataFrame) -> list[DataFrame]:
    """The nodes of every tree, a table per ``BLOCK_LEVELS`` levels, up to one node per tree."""
    out = [stored(placed, "merkle-leaves")]
    while True:
        below = out[-1].select("tree", _block(), "pos", "total", "leaf").groupBy("tree", "block")
        out.append(stored(below.applyInArrow(_parent, "tree string, pos bigint, total bigint, leaf binary"), "merkle-nodes"))
        if (out[-1].agg(F.max("total")).first()[0] or 0) <= 1:
            return out


def _down(nodes: pa.Table, above: pa.Table) -> pa.Table:
    nodes, root, levels = _ordered(nodes)
    over = [(p["left"], p["right"]) for p in above.column("path")[0].as_py()]
    paths = [siblings(root, at, levels) + over for at in range(nodes.num_rows)]
    sides = [[{"left": a, "right": b} for a, b in p] for p in paths]
    same = {c: pa.array([above.column(c)[0].as_py()] * nodes.num_rows, pa.string()) for c in ("subroot", "root")}
    return pa.table({"tree": nodes.column("tree"), "pos": nodes.column("pos"), "path": pa.array(sides, SIDES), **same})


def paths(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tree, pos, path, subroot and root of the nodes of the round above the leaves, from those of the tops."""
    schema = f"tree string, pos bigint, path {PATH}, subroot string, root string"
    for nodes in reversed(tables[1:-1]):
        blocks = nodes.select("tree", _block(), "pos", "total", "leaf").groupBy("tree", "block")
        tops = stored(blocks.cogroup(tops.groupBy("tree", "pos")).applyInArrow(_down, schema), "merkle-paths")
    return tops


def _versions(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Per leaf its proof and the copied ancestors of the version with its changed (else its own) leaf."""
    nodes, root, levels = _ordered(nodes)
    path = [(p["left"], p["right"]) for p in above.column("path")[0].as_py()]
    over = "".join(a + b for a, b in path)
    own = [d.hex() for d in nodes.column("leaf").to_pylist()]
    proofs, copied = [], []
    for at, (leaf, changed) in enumerate(zip(own, nodes.column("changed").to_pylist())):
        inside = "".join(a + b for a, b in siblings(root, at, levels))
        proofs.append(digest((inside, over)))
        version = [n.digest for n in with_leaf(root, at, levels, changed.hex() if changed is not None else leaf)]
        for left, right in path:
            version.append(digest((left, version[-1], right)))
        copied.append(version)
    same = {c: [above.column(c)[0].as_py()] * nodes.num_rows for c in ("subroot", "root")}
    return pa.table(
        {
            "doc_id": nodes.column("doc_id"),
            "tree": nodes.column("tree"),
            "pos": nodes.column("pos"),
            "tampered": pa.array([c is not None for c in nodes.column("changed").to_pylist()]),
            "leaf": pa.array(own, SHA),
            "subroot": pa.array(same["subroot"], SHA),
            "root": pa.array(same["root"], SHA),
            "proof_sha256": pa.array(proofs, SHA),
            "copied": pa.array(copied, pa.list_(SHA)),
        }
    )


@dataclass(frozen=True)
class Manifest:
    """``nodes``: all nodes of the trees of the sources, a table per round; ``tops``: those of the tree
    over the sources; ``versions``: a row per leaf with ``copied``, the version's leaf and its
    ancestors up to the root (at level k the node ``pos div 16**k`` of its tree)."""

    nodes: list[DataFrame]
    tops: list[DataFrame]
    versions: DataFrame


def manifest(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> Manifest:
    """The trees over ``docs``, and the version that each row would make."""
    rows = stored(leaves(docs, tampered, text), "merkle-rows")
    kind = rows.schema["doc_id"].dataType.simpleString()
    trees = rounds(numbered(rows, "doc_id", "leaf"))
    subroots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "leaf")
    over = rounds(numbered(subroots, "name"))

    whole = over[-1].select("tree", "pos", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.hex("leaf").alias("root"))
    whole = paths(over, whole.withColumn("root", F.lower("root")))
    named = over[0].select("tree", _block(), "pos", "total", "leaf", "name").groupBy("tree", "block")
    schema = f"tree string, pos bigint, path {PATH}, subroot string, root string"
    each = stored(named.cogroup(whole.groupBy("tree", "pos")).applyInArrow(_of_source, schema), "merkle-paths")

    above = paths(trees, each)
    blocks = trees[0].select("doc_id", "tree", _block(), "pos", "total", "leaf", "changed").groupBy("tree", "block")
    schema = (
        f"doc_id {kind}, tree string, pos bigint, tampered boolean, leaf string, subroot string, root string, "
        "proof_sha256 string, copied array<string>"
    )
    versions = blocks.cogroup(above.groupBy("tree", "pos")).applyInArrow(_versions, schema)
    return Manifest(trees, over, versions)


def _of_source(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The path above the root of every source, under the source's own name."""
    found = _down(nodes, above)
    nodes = nodes.sort_by("pos")
    subroots = pa.array([d.hex() for d in nodes.column("leaf").to_pylist()], SHA)
    zeros = pa.array([0] * nodes.num_rows, pa.int64())
    return pa.table({"tree": nodes.column("name"), "pos": zeros, "path": found.column("path"), "subroot": subroots, "root": found.column("root")})


def op12_merkle(spark, folder: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    versions = manifest(documents(spark, folder), tampered, lower_ascii(F.col("text"))).versions
    folded = F.element_at("copied", -1)
    return versions.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("folded_root"), (folded == F.col("root")).alias("verified")
    )


def _level_sql(name: str, levels: int) -> str:
    """The levels of a forest ``{name}0`` (tree, idx, digest, n) with the digests beside each node."""
    out = []
    run = "PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN"
    for k in range(levels):
        out.append(
            f"""{name}side{k} AS (
    SELECT tree, idx, n, digest,
        coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name}{k}
), {name}{k + 1} AS (
    SELECT tree, idx // 16 AS idx, (any_value(n) + 15) // 16 AS n,
        CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest
    FROM {name}{k} GROUP BY tree, idx // 16
)"""
        )
    return ", ".join(out)


def _climb_sql(source: str, name: str, levels: int) -> str:
    """Folds ``folded`` and collects ``proof`` through the levels of a forest."""
    out = []
    for k in range(levels):
        out.append(
            f"""{name}climb{k + 1} AS (
    SELECT c.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || c.folded || s.r) ELSE c.folded END AS folded,
        c.proof || s.l || s.r AS proof)
    FROM {source if k == 0 else f'{name}climb{k}'} c JOIN {name}side{k} s ON s.tree = c.{name}_tree AND s.idx = c.{name}_pos // {FAN**k}
)"""
        )
    return ", ".join(out)


def _crc_sql(text: str) -> str:
    """Unsigned crc32 of a text of ASCII characters."""
    bits = "list_reduce(CAST(range(8) AS BIGINT[]), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _field_sql(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


SQL_LEVELS = 8  # 16**8 rows a source
_LEAF = " || ".join(_field_sql(c) for c in COLUMNS)
_CHANGED = _LEAF.replace(
    _field_sql("text"), _field_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
)
OP12_SQL = f"""
WITH rows AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_LEAF}) AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {_crc_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN sha256({_CHANGED}) END AS changed
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total
    FROM rows
), src0 AS (
    SELECT tree, pos AS idx, total AS n, leaf AS digest FROM placed
), {_level_sql('src', SQL_LEVELS)}, top0 AS (
    SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, digest, tree AS name FROM src{SQL_LEVELS}
), {_level_sql('top', SQL_LEVELS)}, start AS (
    SELECT p.doc_id, p.leaf, p.tree AS src_tree, p.pos AS src_pos, '' AS top_tree, t.idx AS top_pos,
        t.digest AS subroot, coalesce(p.changed, p.leaf) AS folded, '' AS proof
    FROM placed p JOIN top0 t ON t.name = p.tree
), {_climb_sql('start', 'src', SQL_LEVELS)}, {_climb_sql(f'srcclimb{SQL_LEVELS}', 'top', SQL_LEVELS)}
SELECT c.doc_id, c.leaf, c.subroot, r.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root,
    c.folded = r.digest AS verified
FROM topclimb{SQL_LEVELS} c JOIN top{SQL_LEVELS} r ON TRUE
"""

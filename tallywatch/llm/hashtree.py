"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At every node each child draws a number from the
hash of the document's id and the child's name, scaled by the child's weight, and the smallest
draw wins (exponential draws: a child wins in proportion to its weight). A child's draw does not
depend on its siblings, so when weights change, documents move only into or out of subtrees whose
weight changed; inside all other subtrees every draw is what it was. So a shard that joins later is
a region of its own beside the regions that were there (``grown``): whatever the number of shards,
it takes documents from all of them and none of them gives one to another.

Defined results: a null id is hashed as the text 'null', so all such rows share a shard; a null
text has size 1 and the checksum of nothing; equal rows get neighbouring slots; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.llm.common import documents

SLICE_DIGITS = 3
RUN = 65_536


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """Shards 0.. in regions of ``racks`` x ``per_rack``, all founded together."""
    full = racks * per_rack
    return [Leaf(s // full, s % full // per_rack, s) for s in range(shards)]


def grown(tree: Sequence[Leaf], shards: int = 1) -> list[Leaf]:
    """``tree`` with further shards, each a region of its own; the leaves of ``tree`` stay what they are."""
    region, shard = (max((f(leaf) for leaf in tree), default=-1) + 1 for f in (lambda x: x.region, lambda x: x.shard))
    return [*tree, *(Leaf(region + k, 0, shard + k) for k in range(shards))]


@dataclass(frozen=True)
class Child:
    name: str
    weight: float
    value: int | tuple[Child, ...]  # a shard, or the children


def nested(tree: Sequence[Leaf]) -> tuple[Child, ...]:
    """Regions of racks of shards; a node weighs what its shards weigh, and those without weight are out."""
    live = [leaf for leaf in tree if leaf.weight > 0]
    if not live:
        raise ValueError("the tree has no shard with a weight")

    def node(name: str, children: tuple[Child, ...]) -> Child:
        return Child(name, sum(c.weight for c in children), children)

    def rack(k: int, r: int) -> Child:
        return node(f"k{k}.{r}", tuple(Child(f"s{x.shard}", x.weight, x.shard) for x in live if (x.region, x.rack) == (k, r)))

    def region(k: int) -> Child:
        return node(f"r{k}", tuple(rack(k, r) for r in sorted({x.rack for x in live if x.region == k})))

    return tuple(region(k) for k in sorted({leaf.region for leaf in live}))


def draw(key: Column, node: Column, weight: Column) -> Column:
    """An exponential number of the given rate from 52 bits of the hash of key and node."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), node).cast("binary")), 1, 13), 16, 10)
    uniform = (bits.cast("bigint").cast("double") + F.lit(1.0)) / F.lit(float(2**52))
    return -F.log(uniform) / weight


def _literal(children: tuple[Child, ...]) -> Column:
    def value(c: Child) -> Column:
        return F.lit(c.value) if isinstance(c.value, int) else _literal(c.value)

    return F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), value(c).alias("value")) for c in children))


def place(doc_id: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a document, a built-in expression over its id. The tree is one constant, so the
    expression has three steps whatever the number of shards."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))

    def winner(children: Column) -> Column:
        """The value of the child with the smallest draw; the first of equal draws."""
        drawn = F.transform(children, lambda c, i: F.struct(draw(key, c["name"], c["weight"]).alias("d"), i.alias("i")))
        return F.element_at(children, F.array_min(drawn)["i"] + 1)["value"]

    return winner(winner(winner(_literal(nested(tree)))))


def shard_documents(docs: DataFrame, tree: Sequence[Leaf], larger: Sequence[Leaf]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Slots are gapless per shard. Equal rows are counted before any shuffle and numbered as one run,
    so a third of all rows being one and the same row costs one row of work. A shard is numbered
    in slices by hash: only the slice sums of a shard are brought into order together.
    """
    utf8 = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(utf8) + 1).cast("bigint").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
    )
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    own_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = same.select(
        "*",
        place(F.col("doc_id"), tree).cast("int").alias("shard"),
        place(F.col("doc_id"), larger).cast("int").alias("grown_shard"),
        F.substring(F.md5(F.concat_ws(":", own_id, "size", "text_crc32").cast("binary")), 1, SLICE_DIGITS).alias("slice"),
    )
    slices = placed.groupBy("shard", "slice").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # 16 ** SLICE_DIGITS rows per shard at most, whatever the number of documents.
    starts = slices.select(
        "shard", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("slice_start")
    )
    earlier = (
        Window.partitionBy("shard", "slice")
        .orderBy("doc_id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = placed.withColumn("within", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        starts, ["shard", "slice"]
    )
    runs = numbered.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(RUN))))
    each = runs.withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.least(F.lit(RUN), F.col("n") - F.col("run")) - 1))
    )
    return each.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("slice_start") + F.col("within") + F.col("run") + F.col("i")).cast("bigint").alias("slot"),
        "grown_shard",
    )


SHARDS = 16


def op4_hash_tree(spark, folder: str) -> DataFrame:
    tree = even_tree(SHARDS)
    return shard_documents(documents(spark, folder), tree, grown(tree))


def _place_sql(children: tuple[Child, ...]) -> str:
    """The shard below a node as one expression over ``key``."""
    draws = [f"-ln((CAST('0x' || substr(md5(key || '/{c.name}'), 1, 13) AS BIGINT) + 1) / 4503599627370496.0) / {c.weight!r}" for c in children]
    values = [str(c.value) if isinstance(c.value, int) else _place_sql(c.value) for c in children]
    cases = " ".join(f"WHEN {d} <= least({', '.join(draws)}) THEN {v}" for d, v in zip(draws, values))
    return f"CASE {cases} END"


# The crc of a text goes byte by byte through the table of the 256 remainders, which is made from its polynomial.
OP4_SQL = f"""
WITH remainders AS (
    SELECT list(list_reduce(CAST(range(8) AS BIGINT[]), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), b) ORDER BY b) AS r
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)
), texts AS (
    SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes
    FROM documents
), rows AS (
    SELECT doc_id, size, key,
        xor(list_reduce(bytes, lambda c, b: xor(r[1 + (xor(c, b) & 255)], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
    FROM texts, remainders
), placed AS (
    SELECT doc_id, size, text_crc32, substr(md5(key || ':' || size || ':' || text_crc32), 1, {SLICE_DIGITS}) AS slice,
        CAST({_place_sql(nested(even_tree(SHARDS)))} AS INTEGER) AS shard, CAST({_place_sql(nested(grown(even_tree(SHARDS))))} AS INTEGER) AS grown_shard
    FROM rows
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
    row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM placed
"""

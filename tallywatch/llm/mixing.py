"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. A flow network sends the words of
each pattern to the quotas of its sources; taking a pattern once more costs more than the time
before (convex costs), so no document is repeated while another one could still be used. The
network has one node per pattern and source, whatever the number of documents. Within a pattern
all documents get the same number of whole passes, and a seeded order decides who is in the last,
partial one.

Defined results: a null text has no words; documents without words are not taken; a null source
is a source of its own, after all others; a null or empty membership list is the list of that one
source; equal rows are separate documents and interchangeable; an empty table gives an empty mix;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.llm.common import bounded, stored, word_count

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
PASS_COSTS = (1, 3, 5)  # marginal costs of the square of the passes
MOST_PATTERNS = 100_000
SEED = "mix-1"


def water_level(sizes: Sequence[int], weights: Sequence[float], most: int = MOST_PASSES) -> list[float]:
    """Targets that share the sum of ``sizes`` by weight, none above ``most`` times its size.

    The excess of capped sources is reshared by weight until none is above: that ends at one
    common level, at which every source has the smaller of its cap and weight times level.
    """
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, weight = sum(sizes), sum(weights)
    targets = [0.0] * len(sizes)
    for at, i in enumerate(order):
        level = left / weight
        if level <= most * sizes[i] / weights[i]:
            for j in order[at:]:
                targets[j] = level * weights[j]
            break
        targets[i] = float(most * sizes[i])
        left -= most * sizes[i]
        weight -= weights[i]
    return targets


def route(
    capacities: Sequence[int],
    members: Sequence[Sequence[int]],
    quotas: Sequence[int],
    costs: Sequence[float] = PASS_COSTS,
) -> list[dict[int, int]]:
    """Min-cost flow from patterns to quotas: words of each pattern for each of its sources.

    Pattern p may send ``capacities[p]`` words per pass at that pass's cost, which rises from pass
    to pass and is the same for all patterns. A cheapest flow is then found pass by pass: paths
    that use only passes so far are exhausted, by shortest augmenting paths, before a pass of a
    higher cost opens.
    """
    if any(b <= a for a, b in zip(costs, costs[1:])):
        raise ValueError("costs must rise from pass to pass")
    flow: list[dict[int, int]] = [{} for _ in capacities]
    into: list[dict[int, int]] = [{} for _ in quotas]  # source -> pattern -> words, for the way back
    room = list(quotas)
    for _ in costs:
        spare = list(capacities)
        for start in range(len(capacities)):
            while spare[start] > 0:
                path = _augmenting(start, members, into, room)
                if path is None:
                    break
                moved = min(spare[start], room[path[-1][1]])
                for (_, source), (pattern, _) in zip(path, path[1:]):
                    moved = min(moved, flow[pattern][source])
                for at, (pattern, source) in enumerate(path):
                    if at:
                        given = path[at - 1][1]
                        flow[pattern][given] -= moved
                        into[given][pattern] -= moved
                    flow[pattern][source] = flow[pattern].get(source, 0) + moved
                    into[source][pattern] = into[source].get(pattern, 0) + moved
                spare[start] -= moved
                room[path[-1][1]] -= moved
    return flow


def _augmenting(start, members, into, room):
    """Shortest path pattern -> source -> (takes words back from) pattern -> ... -> open source."""
    came: dict[int, tuple[int, tuple[int, int] | None]] = {}
    queue, seen = deque([(start, None)]), {start}
    while queue:
        pattern, step = queue.popleft()
        for source in members[pattern]:
            if source in came:
                continue
            came[source] = (pattern, step)
            if room[source] > 0:
                path = []
                at: int | None = source
                while at is not None:
                    pattern, at_step = came[at]
                    path.append((pattern, at))
                    at = at_step
                return path[::-1]
            for other, words in into[source].items():
                if words > 0 and other not in seen:
                    seen.add(other)
                    queue.append((other, source))
    return None


def mix(
    docs: DataFrame,
    memberships: Column,
    weights: Sequence[float] = WEIGHTS,
    costs: Sequence[float] = PASS_COSTS,
    seed: str = SEED,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """One row per document: ``keep``, size, memberships, passes, and the targets of its sources.

    ``memberships`` is an array of source names per document. Sources in order of code points,
    null last, weigh ``weights`` in turn; ``len(costs)`` is the largest number of passes.
    Returns the columns of ``keep`` followed by size, sources (array), source_sizes (array),
    targets (array) and copies (how often the document is taken as a whole).
    """
    spark = docs.sparkSession
    nameless = F.array(F.lit(None).cast("string"))
    sources = F.sort_array(F.array_distinct(F.coalesce(memberships, nameless)))
    sources = F.when(F.size(sources) == 0, nameless).otherwise(sources)
    order = F.md5(
        F.concat_ws(
            ":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit(""))
        ).cast("binary")
    )
    sized = docs.select(
        F.struct(*keep).alias("kept"),
        F.to_json(F.struct(sources.alias("s")), {"ignoreNullFields": "false"}).alias("pattern"),
        sources.alias("sources"),
        word_count(F.col("text")).alias("size"),
        order.alias("turn"),
        F.monotonically_increasing_id().alias("row"),
    )
    sized = stored(sized, "mix-sizes").withColumn("bucket", F.substring("turn", 1, 3))

    totals = sized.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("sources").alias("sources"))
    patterns = sorted(bounded(totals, MOST_PATTERNS, "membership patterns"), key=lambda r: r["pattern"])
    names = sorted({s for r in patterns for s in r["sources"]}, key=lambda s: (s is None, s or ""))
    index = {name: i for i, name in enumerate(names)}
    members = [[index[s] for s in r["sources"]] for r in patterns]
    source_sizes = [0] * len(names)
    for r, own in zip(patterns, members):
        for i in own:
            source_sizes[i] += r["size"]
    targets = water_level(source_sizes, [weights[i % len(weights)] for i in range(len(names))], len(costs))
    flow = route([r["size"] for r in patterns], members, [int(t) for t in targets], costs)

    plan = [
        (
            r["pattern"],
            [source_sizes[i] for i in own],
            [targets[i] for i in own],
            *(divmod(sum(sent.values()), r["size"]) if r["size"] else (0, 0)),
        )
        for r, own, sent in zip(patterns, members, flow)
    ]
    planned = spark.createDataFrame(
        plan, "pattern string, source_sizes array<bigint>, targets array<double>, passes bigint, rest bigint"
    )
    chosen = _last_pass(sized, planned.select("pattern", "rest"))
    # One row per pattern, and their number is checked above.
    return chosen.join(F.broadcast(planned.drop("rest")), "pattern").select(
        "kept.*",
        "size",
        "sources",
        "source_sizes",
        "targets",
        F.when(F.col("size") > 0, F.col("passes") + F.col("chosen").cast("int")).otherwise(0).cast("int").alias("copies"),
    )


def _last_pass(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``chosen``: documents in seeded order, each one that still fits into the pattern's rest,
    and then the one other document whose size comes nearest to what is still missing."""
    tried = stored(_in_turn(sized, wanted), "mix-tried")
    missing = (
        tried.filter((F.col("bucket") == F.col("end_bucket")))
        .groupBy("pattern")
        .agg((F.first("left") - F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0))).alias("missing"))
    )
    others = tried.filter(~F.col("chosen")).select("pattern", "bucket", "turn", "row", "size")
    more, missing = _fitting(others, stored(missing, "mix-missing"))
    nearest = (
        others.join(more, "row", "left_anti")
        .join(F.broadcast(missing), "pattern")
        .withColumn("off", F.abs(F.col("size") - F.col("missing")))
        .filter(F.col("off") < F.col("missing"))
        .groupBy("pattern")
        .agg(F.min(F.struct("off", "turn", "row")).alias("best"))
        .select(F.col("best.row").alias("row"))
    )
    # The words missing at the first misfit bound how many there are of both.
    added = stored(more.unionByName(nearest).withColumn("added", F.lit(True)), "mix-added")
    found = tried.join(added, "row", "left")
    return found.withColumn("chosen", F.col("chosen") | F.coalesce("added", F.lit(False))).drop("added")


def _fitting(others: DataFrame, missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of all other documents that still fit, in seeded order, and what is missing then.

    Documents longer than what is missing are taken out, the rest is taken in turn up to the next
    misfit, and so on until nothing fits; what is missing falls below the misfit each time.
    """
    rows = others.select("row").limit(0)
    others = others.filter("size > 0")
    while True:
        others = stored(others.join(F.broadcast(missing), "pattern").filter("size <= missing").drop("missing"), "mix-fitting")
        if others.isEmpty():
            return rows, missing
        tried = _in_turn(others, missing.withColumnRenamed("missing", "rest"))
        tried = stored(tried.select(*others.columns, "chosen"), "mix-turn")
        chosen = tried.filter("chosen")
        rows = rows.unionByName(chosen.select("row"))
        words = chosen.groupBy("pattern").agg(F.sum("size").alias("words"))
        missing = missing.join(words, "pattern", "left")
        missing = missing.select("pattern", (F.col("missing") - F.coalesce("words", F.lit(0))).alias("missing"))
        missing = stored(missing, "mix-missing")
        others = tried.filter("not chosen").drop("chosen")


def _in_turn(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``chosen``: documents in seeded order while their words fit into the pattern's rest; and
    the slice where it ends, with the words it has left there.

    Only sums per 1/4096 of a pattern are ordered; the one slice in which the rest ends is the
    only one whose documents are.
    """
    slices = sized.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = slices.withColumn("after", F.sum("words").over(up_to)).join(F.broadcast(wanted), "pattern")
    ends = (
        running.filter(F.col("after") > F.col("rest"))
        .groupBy("pattern")
        .agg(F.min(F.struct("bucket", (F.col("rest") - (F.col("after") - F.col("words"))).alias("left"))).alias("end"))
        .select("pattern", F.col("end.bucket").alias("end_bucket"), F.col("end.left").alias("left"))
    )
    ends = stored(ends, "mix-ends")
    placed = sized.join(F.broadcast(ends), "pattern", "left")
    clear = placed.filter(F.col("end_bucket").isNull() | (F.col("bucket") != F.col("end_bucket"))).withColumn(
        "chosen", F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket"))
    )
    in_turn = (
        Window.partitionBy("pattern")
        .orderBy("turn", "row")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = placed.filter(F.col("bucket") == F.col("end_bucket")).withColumn(
        "chosen", F.sum("size").over(in_turn) <= F.col("left")
    )
    return clear.unionByName(within)


def mixed_documents(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own))).alias("whole"),
        F.col("doc_id"),
        F.col("text"),
        F.col(source).alias("member"),
    )
    taken = mix(rows, F.array("member"), keep=("whole",), **options).filter(F.col("copies") > 0)
    repeated = taken.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pass"))
    return repeated.select(*(F.col(f"whole.{n}").alias(c) for c, n in zip(docs.columns, own)))


def op1_mixing(spark, folder: str) -> DataFrame:
    """The mix of the contract: every document has one source."""
    from tallywatch.llm.common import documents

    docs = documents(spark, folder)
    mixed = mix(docs, F.array("source"))
    return mixed.select(
        "doc_id",
        "size",
        F.element_at("source_sizes", 1).alias("source_size"),
        F.element_at("targets", 1).alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"),
        F.col("copies").cast("bigint").alias("copies"),
    )


# The last pass goes from misfit to misfit: a state of ``fill`` is what a source still misses behind
# the document that did not fit; the documents up to the next misfit are taken.
OP1_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS turn
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
caps AS (SELECT *, 3 * source_size / weight::DOUBLE AS ratio FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER earlier, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::DOUBLE AS level
  FROM caps WINDOW earlier AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (SELECT min_by(level, ratio) FILTER (WHERE level <= ratio) AS level FROM levels),
targets AS (
  SELECT c.source, c.source_size,
         CASE WHEN c.ratio < s.level THEN (3 * c.source_size)::DOUBLE ELSE s.level * c.weight END AS target
  FROM caps c, settled s),
quotas AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number, least(floor(target)::BIGINT, 3 * source_size) AS quota,
         CASE WHEN source_size > 0 THEN least(floor(target)::BIGINT, 3 * source_size) // source_size ELSE 0 END AS passes,
         CASE WHEN source_size > 0 THEN least(floor(target)::BIGINT, 3 * source_size) % source_size ELSE 0 END AS rest
  FROM targets),
placed AS (
  SELECT d.doc_id, d.size, d.turn, q.number, q.source_size, q.target, q.passes, q.rest,
         row_number() OVER (PARTITION BY q.number ORDER BY turn, doc_id) AS pos
  FROM sized d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
fill(number, missing, pos) AS (
  SELECT number, rest::HUGEINT, 0::BIGINT FROM quotas
  UNION ALL
  SELECT number, any_value(missing) - coalesce(max(total) FILTER (WHERE total <= missing), 0),
         min(pos) FILTER (WHERE total > missing)
  FROM (SELECT f.number, f.missing, p.pos, sum(p.size) OVER (PARTITION BY f.number ORDER BY p.pos) AS total
        FROM fill f JOIN placed p ON p.number = f.number AND p.pos > f.pos AND p.size <= f.missing AND p.size > 0) t
  GROUP BY number HAVING min(pos) FILTER (WHERE total > missing) IS NOT NULL),
taken AS (
  SELECT number, pos, size FROM (
    SELECT f.number, f.missing, p.pos, p.size, sum(p.size) OVER (PARTITION BY f.number, f.pos ORDER BY p.pos) AS total
    FROM fill f JOIN placed p ON p.number = f.number AND p.pos > f.pos AND p.size <= f.missing AND p.size > 0) t
  WHERE total <= missing),
chosen AS (SELECT DISTINCT number, pos, size FROM taken),
missing AS (
  SELECT q.number, any_value(q.rest) - coalesce(sum(c.size), 0) AS missing
  FROM quotas q LEFT JOIN chosen c ON c.number = q.number GROUP BY q.number),
nearest AS (
  SELECT p.number, min_by(p.pos, (abs(p.size - m.missing), p.pos)) AS pos
  FROM placed p JOIN missing m ON m.number = p.number
  WHERE abs(p.size - m.missing) < m.missing AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.number = p.number AND c.pos = p.pos)
  GROUP BY p.number),
last_pass AS (SELECT number, pos FROM chosen UNION SELECT number, pos FROM nearest),
counted AS (
  SELECT p.*, CASE WHEN p.size = 0 THEN 0 ELSE p.passes + (l.pos IS NOT NULL)::INT END AS copies
  FROM placed p LEFT JOIN last_pass l ON l.number = p.number AND l.pos = p.pos)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM counted
"""

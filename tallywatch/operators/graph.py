"""The counterparty graph of the strongest sender-receiver pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch import constants as C


def pair_scores(scored: DataFrame) -> DataFrame:
    """Highest score per sender and receiver; rows lacking an end are left out."""
    ends = F.col("sender_account").isNotNull() & F.col("receiver_account").isNotNull()
    return (
        scored.filter(ends)
        .groupBy(F.col("sender_account").alias("src"), F.col("receiver_account").alias("dst"))
        .agg(F.max("score").alias("score"))
    )


def network_edges(scored: DataFrame, rows: int = C.EDGE_ROWS) -> DataFrame:
    return pair_scores(scored).orderBy(F.col("score").desc(), "src", "dst").limit(rows)


def network_nodes(scored: DataFrame, rows: int = C.EDGE_ROWS) -> DataFrame:
    """Ends of the listed edges with the risk of their highest score on either side.

    At most two nodes per listed edge exist; up to ``C.BROADCAST_EDGES`` edges their table is broadcast, so that rows
    are filtered before anything is shuffled, and beyond that the planner chooses.
    """
    edges = network_edges(scored, rows)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    sides = scored.select(F.explode(F.array("sender_account", "receiver_account")).alias("id"), "score")
    risk = (
        F.when(F.col("score") >= C.NODE_HIGH, "high").when(F.col("score") >= C.NODE_MEDIUM, "medium").otherwise("low")
    )
    return (
        sides.join(F.broadcast(nodes) if rows <= C.BROADCAST_EDGES else nodes, "id")
        .groupBy("id")
        .agg(F.max("score").alias("score"))
        .select("id", F.substring("id", 1, 8).alias("label"), risk.alias("risk"))
    )

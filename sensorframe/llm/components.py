"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.session import materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of an edge; ``component`` is the smallest node reachable.

    ``edges`` are ``(a, b)`` of one ordered type; self loops and null ends are ignored, direction and
    repetition do not matter. Alternates large-star and small-star steps until every node hangs on its
    component's smallest node, which one aggregate over the nodes tells, so edges that are stars already take
    no step. A step is one aggregate and one join on the
    node, so a node with very many neighbours is pre-aggregated and then one side of a splittable join.
    Each round is written to the shared folder. Raises if ``rounds`` do not suffice; the number needed
    grows with the logarithm of the longest chain.
    """
    now = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "edges"
    )
    for _ in range(rounds + 1):
        if _settled(now):
            break
        now = materialize(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Whether the distinct edges, ``a > b``, are stars: no node hangs on two, or on one that hangs on another."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hung on the smallest of the node and its neighbours. ``a > b`` in and out."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are hung on the smallest of these. ``a > b`` in and out."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()

"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.session import cut_lineage


EDGES = 50_000
"""Edges that a task takes at least, unless cores would idle: small graphs need few tasks."""


def _edge(a, b):
    return F.struct(a.alias("a"), b.alias("b"))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest of its neighbourhood."""
    a, b = F.col("a"), F.col("b")
    both = edges.select(F.inline(F.array(_edge(a, b), _edge(b, a))))
    low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    # one row per edge at most, whatever repeats; the small star drops repeats
    return both.join(low, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    m = F.col("m")
    lifted = down.join(low, "a").select(F.inline(F.array(_edge(F.col("b"), m), _edge(F.col("a"), m))))
    return lifted.filter(F.col("a") != F.col("b")).coalesce(tasks).distinct().coalesce(tasks)


def _settled(edges: DataFrame, tasks: int) -> bool:
    """Whether distinct (larger, smaller) edges are stars: no node hangs on two others, or on
    one that hangs itself. Further rounds leave stars as they are."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("bears")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("bears")),
    )))
    loads = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("bears").alias("bears"))
    return loads.filter("hangs > 1 OR (hangs = 1 AND bears = 1)").coalesce(tasks).isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges to (node, root): the smallest node of each component.

    Nodes without an edge do not appear. Each round's edges are checkpointed to the shared
    folder, so lost executors cost at most one round.
    """
    pairs = edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct()
    current = cut_lineage(pairs)
    tasks = max(current.sparkSession.sparkContext.defaultParallelism, -(-current.count() // EDGES))
    current = current.coalesce(tasks)
    for _ in range(max_rounds):
        current = cut_lineage(_small_star(_large_star(current, tasks), tasks))
        if _settled(current, tasks):
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

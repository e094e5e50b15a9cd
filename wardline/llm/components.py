"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(a long, b long)`` -> ``(id, component)``: for every vertex the
    smallest vertex it reaches.

    Alternates two steps until nothing changes: every vertex sends its larger
    neighbours to the smallest vertex around it (large star), then its smaller
    ones (small star).  The number of rounds grows with the logarithm of the
    longest path; each round is written to the shared folder.  Loops, repeated
    and empty edges are fine, null ends are ignored."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        now = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = now.groupBy("a").agg(F.min("b").alias("low"))
        joined = now.join(least, "a")
        now = stored(joined.select("a", F.col("low").alias("b"))
                     .union(joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct(), "edges")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _stars(edges: DataFrame) -> bool:
    """Every vertex has one smaller neighbour, and that has none."""
    ends = edges.groupBy("a").agg(F.count("*").alias("n"), F.lit(0).alias("low")).union(
        edges.groupBy(F.col("b").alias("a")).agg(F.lit(0).cast("long").alias("n"), F.lit(1).alias("low")))
    both = ends.groupBy("a").agg(F.sum("n").alias("n"), F.max("low").alias("low"))
    return both.where("n > 1 or (n = 1 and low = 1)").limit(1).count() == 0


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` components after more links between vertices, found on the
    graph of the known components, which is much smaller."""
    if not links.limit(1).count():
        return known
    of = lambda end: known.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    again = components(lifted)
    moved = known.join(again.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    alone = again.join(known.select("id"), "id", "left_anti")
    return moved.select("id", F.coalesce("to", "component").alias("component")).union(alone.select("id", "component"))

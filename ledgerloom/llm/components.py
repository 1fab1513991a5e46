"""Connected components by alternating large-star and small-star steps, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import finished, materialise

#: Edges of a task that writes them (about).
EDGES = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect the neighbours of each node to the least node among them and itself: all larger ones (large), or all smaller ones and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node that has a link to another: node, component (the least node reachable). Null ends are ignored.

    The number of rounds grows with the logarithm of the longest path; every round is written to the shared folder.
    """
    edges = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges = materialise(edges, "edges")
    seen = None
    while True:
        # a forest of stars is a fixed point: every larger end points to the least one
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen = mark
        last, edges = edges, materialise(_star(_star(edges, True), False).distinct().coalesce(max(1, mark[0] // EDGES)), "edges")
        finished(last)

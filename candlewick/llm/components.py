"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.storage import materialize, remove


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge or is the smaller end of all its own: then no iteration changes a row."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.agg(F.max(((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).cast("int"))).first()[0] != 1


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b: long) that is not the smallest of its component; comp is that one.

    Each iteration is written to the shared folder; their number grows with the logarithm of the longest chain, and none
    follows once all components are stars. A node with any number of edges costs one partial minimum a task, and its
    edges are joined, never gathered.
    """
    now = materialize(_small_star(edges.where("a <> b")), "stars")
    while not _all_stars(now):
        following = materialize(_small_star(_large_star(now)), "stars")
        remove(now)
        now = following
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))

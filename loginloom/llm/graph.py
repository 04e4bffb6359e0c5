"""Connected components by alternating large and small stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_spool, spool


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b: each node's greater (large) or smaller neighbours are tied to the least of all (smaller) ones."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        tied = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m")))
    return tied.filter("a <> b")


def _stars(edges: DataFrame) -> bool:
    """Whether edges (a, b), a > b, without repeated ones, tie every node straight to the least node of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.filter(F.col("up") + F.col("down") > 1).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that edges (a, b) reach from it), for every node with an edge."""
    pair = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    held = spool(pair, "edges")
    while not _stars(held):
        after = spool(_star(_star(held, True), False).distinct(), "edges")
        drop_spool(held)
        held = after
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(held.select(F.col("b"), F.col("b")).distinct())

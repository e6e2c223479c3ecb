"""Connected components with DataFrame operations: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import written


def _low_star(edges: DataFrame, down: bool) -> DataFrame:
    """Every node's neighbours are linked with the least of them and the node.

    ``down``: only neighbours below the node (small star), else only those above it (large star).
    Minima are aggregated before the shuffle, so a node of any degree is never gathered.
    """
    if down:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        moved = both.join(low, "u").select(F.col("v").alias("x"), "m")
        out = moved.unionByName(low.select(F.col("u").alias("x"), "m"))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("x"), "m")
    return out.filter(F.col("x") != F.col("m")).select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a < b): the least node that it reaches."""

    def state(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = written(edges.select("a", "b").filter(F.col("a") < F.col("b")).distinct(), "edges")
    was, is_ = None, state(now)
    while is_ != was:
        was = is_
        now = written(_low_star(written(_low_star(now, False), "large-star"), True), "small-star")
        is_ = state(now)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

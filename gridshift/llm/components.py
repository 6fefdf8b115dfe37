"""Connected components of a distributed edge table (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the least node of its component.

    Each round is two group-by-minimum steps and two equi-joins; the number of rounds grows with
    the logarithm of the nodes. Links stay in tables all the way; the driver sees a count and a
    checksum. Loops (u = v) only name a node. No edges: no rows.
    """
    e = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while mark != (mark := _mark(e)):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = staged(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(
        e.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("root"))
    ).groupBy("node").agg(F.min("root").alias("root"))

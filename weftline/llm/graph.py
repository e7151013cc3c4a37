"""Connected components of large edge tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


#: Edges of a node are dealt over this many tasks where they meet its least neighbour.
SALTS = 8


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with the m of their u."""
    many = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(many, ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """u, c: every node with an edge, and the least node of its component.

    edges: u, v (long). Each round rewires every node to the least neighbour known, first
    through its larger neighbours, then through its smaller ones; the number of rounds
    grows with the logarithm of the component's size. A node's neighbours are never
    gathered: their minimum is aggregated and joined back, in salted groups.
    """
    now = written(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").select("u", "v").distinct(), "edges")
    spark, state = edges.sparkSession, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _met(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        lower = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = _met(lower, least).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = written(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "edges")
        removed(spark, now)
        removed(spark, large)
        now = small
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (row["n"], row["h"]):
            break
        state = row["n"], row["h"]
    return now.groupBy("u").agg(F.min("v").alias("c")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("c")).distinct())

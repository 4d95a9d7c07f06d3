"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014).

Every round is a grouped minimum and a join on node keys; lineage is cut in shared storage after each, and the edges
of the round before are deleted. Only a count of changed edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternsift.llm.common import discard, settle, shared_dir

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour (larger ones for the large star, smaller ones and the node for the small star) to the least."""
    if large:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        both = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m"))
    least = both.groupBy("n").agg(F.min("m").alias("r")).select("n", F.least("n", "r").alias("r"))
    linked = both.join(least.hint("merge"), "n")  # both grow with the data: never a broadcast
    if large:
        out = linked.where(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("r").alias("v"))
    else:
        out = linked.select(F.col("m").alias("u"), F.col("r").alias("v")).union(least.select(F.col("n").alias("u"), F.col("r").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of comparable keys -> (node, root) with root the least key of the component; nodes with edges only."""
    spark = edges.sparkSession
    path = shared_dir(spark)
    now = settle(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)
    mark = None
    for _ in range(ROUNDS):
        new_path = shared_dir(spark)
        now = settle(_star(_star(now, True), False), new_path)
        discard(spark, path)
        path = new_path
        # The sum of pair hashes tells a fixed point; equal sums of two different edge sets have a chance of 2^-64.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node joins its larger neighbours to its smallest one."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u, v), nodes of any one ordered type -> (node, component): the smallest node it reaches; only nodes with edges are listed.

    Every round is written to the shared folder, so a lost executor costs one round at most. Only a count
    and a checksum reach the driver. Loops (u = v) are ignored.
    """
    now = scratch.write(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = None
    while True:
        after = scratch.write(_small_star(_large_star(now)), "edges")
        new = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if new == state or not new[0]:
            break
        state = new
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())

"""Inner-product weights (x, v, w)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .reductions import variable_variance


def uniform(spark: SparkSession, nx: int, nv: int = 1) -> DataFrame:
    return spark.range(nx).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("v"), F.lit(1.0).alias("w"))


def custom(weights: DataFrame, nx: int, nv: int) -> DataFrame:
    """User weights (x, v, w), checked for size."""
    n = weights.count()
    if n != nx * nv:
        raise ValueError(f"{n} weights for {nx} x {nv} cells")
    return weights.select(F.col("x").cast("long").alias("x"), F.col("v").cast("int").alias("v"), F.col("w").cast("double").alias("w"))


def geo_trapz_2d(spark: SparkSession, n_lat: int, n_lon: int, nv: int = 1, radius: float = 1.0) -> DataFrame:
    """Trapezoidal areas on a sphere: latitudes -90..90, longitudes 0..360 without the end; the first longitude weighs 0."""
    rad = math.pi / 180
    d_lat, d_lon = 180.0 / (n_lat - 1) * rad, 360.0 / n_lon * rad
    i, j = F.expr(f"id div {n_lon}"), F.col("id") % n_lon
    lat = F.lit(-90.0 * rad) + i * F.lit(d_lat)
    w = F.lit(radius * radius) * F.abs(F.cos(lat) * F.when((i == 0) | (i == n_lat - 1), d_lat / 2).otherwise(d_lat)) * F.when(j == 0, 0.0).otherwise(d_lon)
    return spark.range(n_lat * n_lon).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("v"), w.alias("w"))


def geo_trapz_3d(spark: SparkSession, n_lat: int, n_lon: int, n_level: int, nv: int = 1, radius: float = 1.0) -> DataFrame:
    """The spherical weights repeated along a third axis."""
    flat = geo_trapz_2d(spark, n_lat, n_lon, nv, radius)
    levels = flat.select("x", "v", "w", F.explode(F.sequence(F.lit(0), F.lit(n_level - 1))).alias("level"))
    return levels.select((F.col("x") * n_level + F.col("level")).alias("x"), "v", "w")


def normalized(weights: DataFrame, field: DataFrame) -> DataFrame:
    """Weights over the variance of their variable."""
    var = variable_variance(field)
    return weights.join(F.broadcast(var), "v").select("x", "v", (F.col("w") / F.col("var")).alias("w"))

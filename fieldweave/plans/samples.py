"""Fields made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fields import densify

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
FLAGS = ("AF", "AO", "NF", "NO", "RF", "RO")
DAYS = 2499


def _place(column, names):
    out = F.lit(None).cast("long")
    for i, n in enumerate(names):
        out = F.when(column == n, F.lit(i).cast("long")).otherwise(out)
    return out


def events(spark: SparkSession, sf_dir: str, hours: int = 1, two: bool = False) -> DataFrame:
    """t: bins of `hours` since 2024-01-01; x: event type; v0: sum of value, v1: count."""
    nt = 720 // hours
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(f"timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts) div {hours}").alias("t"), _place(F.col("event_type"), EVENT_TYPES).alias("x"), "value")
    sums = rows.where(F.col("t").between(0, nt - 1) & F.col("x").isNotNull()).groupBy("t", "x").agg(F.sum("value").alias("s"), F.count("*").cast("double").alias("c"))
    sparse = sums.select("t", "x", F.lit(0).alias("v"), F.col("s").alias("val"))
    if two:
        sparse = sums.select("t", "x", F.posexplode(F.array("s", "c")).alias("v", "val"))
    return densify(sparse, nt, len(EVENT_TYPES), 2 if two else 1)


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t: days since 1995-01-02; x: return flag and line status; v: quantity, price, discount, tax."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.expr("datediff(l_shipdate, date'1995-01-02')").cast("long").alias("t"), _place(F.concat("l_returnflag", "l_linestatus"), FLAGS).alias("x"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    sums = rows.where(F.col("t").between(0, DAYS - 1) & F.col("x").isNotNull()).groupBy("t", "x").agg(F.array(F.sum("l_quantity"), F.sum("l_extendedprice"), F.sum("l_discount"), F.sum("l_tax")).alias("a"))
    return densify(sums.select("t", "x", F.posexplode("a").alias("v", "val")), DAYS, len(FLAGS), 4)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t: vec_id; x: place in the vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("x", "val")).select("t", F.col("x").cast("long").alias("x"), F.lit(0).alias("v"), F.col("val").cast("double").alias("val"))

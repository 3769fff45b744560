"""Means, variances and norms of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS4 = 4 * 2.220446049250313e-16


def longtime_mean(field: DataFrame) -> DataFrame:
    """(x, v, mu): partial sums by task, so only one row per cell and task is shuffled."""
    return field.groupBy("x", "v").agg(F.avg("val").alias("mu"))


def block_mean(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("b", "x", "v").agg(F.avg("val").alias("mu"))


def running_mean(field: DataFrame) -> DataFrame:
    """(t, x, v, mu): mean of the snapshots up to t."""
    upto = Window.partitionBy("x", "v").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return field.select("t", "x", "v", F.avg("val").over(upto).alias("mu"))


def block_variance(blocks: DataFrame) -> DataFrame:
    """(b, x, v, var): sample variance; values of rounding size become 1."""
    var = F.var_samp("val")
    return blocks.groupBy("b", "x", "v").agg(F.when(var < EPS4, 1.0).otherwise(var).alias("var"))


def variable_variance(field: DataFrame) -> DataFrame:
    """(v, var): population variance of each variable; NaN counts as missing."""
    return field.where(~F.isnan("val")).groupBy("v").agg(F.var_pop("val").alias("var"))


def l_errors(data: DataFrame, reference: DataFrame, norm: str = "l2") -> DataFrame:
    """One row: l1 (mean absolute), l2 (root of the sum of squares, over n) or linf error; `_rel` divides by the reference's values."""
    both = data.select("t", "x", "v", F.col("val").alias("a")).join(reference.select("t", "x", "v", F.col("val").alias("r")), ["t", "x", "v"])
    e = F.abs(F.col("a") - F.col("r"))
    if norm.endswith("_rel"):
        e = e / F.col("r")
    kinds = {"l1": F.avg(e), "l2": F.sqrt(F.sum(e * e)) / F.count("*"), "linf": F.max(e)}
    if norm.removesuffix("_rel") not in kinds:
        raise ValueError(f"unknown norm {norm!r}")
    return both.agg(kinds[norm.removesuffix("_rel")].alias("error"))


def h1_error(data: DataFrame, reference: DataFrame, dt: float) -> DataFrame:
    """sqrt(sum_t dt * (sum_x (u' - r'))^2) with backward differences; the first snapshot counts 0."""
    both = data.select("t", "x", "v", F.col("val").alias("a")).join(reference.select("t", "x", "v", F.col("val").alias("r")), ["t", "x", "v"])
    back = Window.partitionBy("x", "v").orderBy("t")
    d = F.col("a") - F.col("r")
    step = both.select("t", F.coalesce((d - F.lag(d).over(back)) / dt, F.lit(0.0)).alias("d"))
    return step.groupBy("t").agg(F.sum("d").alias("s")).agg(F.sqrt(F.sum(F.lit(dt) * F.col("s") * F.col("s"))).alias("error"))

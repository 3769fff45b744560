"""Lookups and data products for inspection: nearest bins and points, shifts, slices, peaks, tracers, report tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import period_units


def nearest_frequency(axis: DataFrame, wanted: float) -> DataFrame:
    """One row (f, freq): the closest bin, the first one on ties."""
    key = F.struct(F.abs(F.col("freq") - wanted), F.col("f"))
    return axis.agg(F.min_by(F.struct("f", "freq"), key).alias("r")).select("r.*")


def nearest_coordinates(axes: list[DataFrame], wanted) -> list[DataFrame]:
    """Per axis (i, c): the row whose coordinate is closest."""
    if not isinstance(wanted, (list, tuple)) or len(wanted) != len(axes):
        raise ValueError("give one coordinate per axis")
    return [a.agg(F.min_by(F.struct("i", "c"), F.struct(F.abs(F.col("c") - float(w)), F.col("i"))).alias("r")).select("r.*") for a, w in zip(axes, wanted)]


def shift_half(df: DataFrame, column: str, n: int) -> DataFrame:
    """An axis rolled by half its length."""
    return df.withColumn(column, F.pmod(F.col(column) + n // 2, F.lit(n)))


def slice_axis(field: DataFrame, shape: tuple[int, ...], axis: int, index: int = 0) -> DataFrame:
    """Cells of a d-dimensional field with the given index along one axis; x stays the flattened index."""
    inner = math.prod(shape[axis + 1 :])
    return field.where(F.expr(f"(x div {inner}) % {shape[axis]} = {index}"))


def largest_magnitude(mode: DataFrame) -> DataFrame:
    """All (x, v, mag) at which a mode (x, v, re, im) is largest."""
    mag = mode.select("x", "v", F.hypot("re", "im").alias("mag"))
    top = mag.agg(F.max("mag").alias("top"))
    return mag.join(F.broadcast(top), F.col("mag") >= F.col("top") * (1 - 1e-12)).drop("top")


def data_tracer(field: DataFrame, x: int, v: int = 0, t0: int | None = None, t1: int | None = None) -> DataFrame:
    out = field.where((F.col("x") == x) & (F.col("v") == v))
    if t0 is not None:
        out = out.where(F.col("t") >= t0)
    if t1 is not None:
        out = out.where(F.col("t") < t1)
    return out.select("t", "val")


def mode_tracer(modes: DataFrame, freq: float, points: int = 100, turns: int = 5) -> DataFrame:
    """(m, x, v, i, t, val): Re(phi * conj(exp(i theta))) along `turns` turns of phase; t runs over one period."""
    theta = F.col("i") * F.lit(2 * math.pi * turns / (points - 1))
    rows = modes.select("m", "x", "v", "re", "im", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    value = F.col("re") * F.cos(theta) + F.col("im") * F.sin(theta)
    return rows.select("m", "x", "v", "i", (F.col("i") / F.lit((points - 1) * freq)).alias("t"), value.alias("val"))


def peaks(spectrum: DataFrame, reach: int = 5) -> DataFrame:
    """(f, freq, val) of peaks: above 1.5 times the mean of [i - reach, i + reach), above both neighbours, and the largest
    within 10 % of their frequency; bin 0 is none."""
    order = Window.orderBy("f")  # a spectrum: one row a bin
    rows = spectrum.withColumn("mean", F.avg("val").over(order.rowsBetween(-reach, reach - 1))).withColumn("up", F.lag("val").over(order)).withColumn("down", F.lead("val").over(order))
    rows = rows.where((F.col("val") > 1.5 * F.col("mean")) & (F.col("up").isNull() | (F.col("val") > F.col("up"))) & (F.col("down").isNull() | (F.col("val") > F.col("down"))) & (F.col("freq") > 0))
    near = spectrum.select(F.col("freq").alias("q"), F.col("val").alias("other"))
    best = rows.join(near, F.col("q").between(F.col("freq") * 0.9, F.col("freq") * 1.1)).groupBy("f", "freq", "val").agg(F.max("other").alias("top"))
    return best.where("val = top").select("f", "freq", "val")


def report(spectrum: DataFrame, most: int | None = None) -> DataFrame:
    """Peaks with their periods, frequencies being per hour; with `most`, only that many of the highest."""
    value, unit = period_units(1 / F.col("freq"))
    found = peaks(spectrum).select("f", "freq", "val", value.alias("period"), unit.alias("unit"))
    return found if most is None else found.orderBy(F.desc("val"), "f").limit(most)


def coefficient_series(coeffs: DataFrame, modes=None, t_lo: int | None = None, t_hi: int | None = None) -> DataFrame:
    """Coefficients of chosen modes over [t_lo, t_hi), ready to be drawn: (m, t, then their value columns)."""
    if modes is not None:
        coeffs = coeffs.where(F.col("m").isin([int(m) for m in modes]))
    if t_lo is not None:
        coeffs = coeffs.where(F.col("t") >= t_lo)
    return coeffs if t_hi is None else coeffs.where(F.col("t") < t_hi)


def panels(**fields: DataFrame) -> DataFrame:
    """Fields (x, v, val) side by side: (panel, x, v, val, limit), all with the largest magnitude as their common colour limit."""
    rows = None
    for name, df in fields.items():
        one = df.select(F.lit(name).alias("panel"), "x", "v", "val")
        rows = one if rows is None else rows.unionByName(one)
    limit = rows.agg(F.max(F.abs("val")).alias("limit"))  # one row
    return rows.join(F.broadcast(limit))


def eigenvalues_by_period(eigs: DataFrame) -> DataFrame:
    return eigs.where("freq <> 0").select("f", (1 / F.col("freq")).alias("period"), "m", "lam")


def mode_slice(modes: DataFrame, f: int, m: int) -> DataFrame:
    """A mode's parts, magnitude and phase, with the symmetric colour limit."""
    one = modes.where((F.col("f") == f) & (F.col("m") == m)).select("x", "v", "re", "im", F.hypot("re", "im").alias("mag"), F.atan2("im", "re").alias("phase"))
    limit = one.agg(F.max(F.greatest(F.abs("re"), F.abs("im"))).alias("limit"))
    return one.join(F.broadcast(limit))


def frames(field: DataFrame, sampling: int = 1) -> DataFrame:
    """Every sampling-th snapshot, numbered as a video's frames."""
    return field.where(F.col("t") % sampling == 0).withColumn("frame", F.expr(f"t div {sampling}"))


def compare_series(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("t", F.col("val").alias("a")).join(right.select("t", F.col("val").alias("b")), "t", "full")


def axis(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    """(i, c): n evenly spaced coordinates with both ends."""
    return spark.range(n).select(F.col("id").cast("int").alias("i"), (F.lit(float(lo)) + F.col("id") * F.lit((hi - lo) / (n - 1))).alias("c"))

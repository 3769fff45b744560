"""Snapshot fields: DataFrames (t long, x long, v int, val double), x the row-major spatial index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD = "t long, x long, v int, val double"
STRIDES = {"all": 1, "half": 2, "quarter": 4, "tenth": 10, "hundredth": 100}


def densify(sparse: DataFrame, nt: int, nx: int, nv: int = 1, fill: float = 0.0) -> DataFrame:
    """All (t, x, v) cells; missing ones hold `fill`. The grid is generated, one task range of t at a time."""
    spark = sparse.sparkSession
    grid = spark.range(nt).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nx - 1).cast("long"))).alias("x"))
    grid = grid.select("t", "x", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("v"))
    return grid.join(sparse.select("t", "x", "v", "val"), ["t", "x", "v"], "left").select("t", "x", "v", F.coalesce("val", F.lit(float(fill))).cast("double").alias("val"))


def from_arrays(spark: SparkSession, arrays: list[np.ndarray] | np.ndarray, n_variables: int = 1) -> DataFrame:
    """In-memory datasets [time, x1.., (var)], concatenated along time."""
    parts, t0, shape = [], 0, None
    for a in arrays if isinstance(arrays, list) else [arrays]:
        a = np.asarray(a, float)
        if n_variables == 1 and (a.ndim < 2 or a.shape[-1] != 1 or a.ndim == 2):
            a = a[..., None]
        if shape not in (None, a.shape[1:]):
            raise ValueError("datasets differ in spatial shape")
        shape = a.shape[1:]
        nt, nv = a.shape[0], a.shape[-1]
        flat = a.reshape(nt, -1, nv)
        t, x, v = np.indices(flat.shape).reshape(3, -1)
        import pandas as pd

        parts.append(spark.createDataFrame(pd.DataFrame({"t": t.astype(np.int64) + t0, "x": x.astype(np.int64), "v": v.astype(np.int32), "val": flat.ravel()}), FIELD))
        t0 += nt
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def concat(fields: list[tuple[DataFrame, int]]) -> DataFrame:
    """Datasets (field, snapshots) one after another along time."""
    out, t0 = None, 0
    for field, nt in fields:
        moved = field.withColumn("t", F.col("t") + F.lit(t0).cast("long"))
        out = moved if out is None else out.unionByName(moved)
        t0 += nt
    return out


def time_slice(field: DataFrame, t0: int, t1: int) -> DataFrame:
    """Snapshots t0 <= t < t1; the range reaches the scan."""
    return field.where((F.col("t") >= t0) & (F.col("t") < t1))


def time_indices(spec, nt: int) -> list[int] | int:
    """A stride for a named subset, else the list of snapshots; the default is the first, the (nt mod 2)-th and the last."""
    if spec is None:
        return sorted({0, nt % 2, nt - 1})
    if isinstance(spec, str):
        if spec not in STRIDES:
            raise ValueError(f"unknown time subset {spec!r}")
        return STRIDES[spec]
    return [int(i) for i in np.asarray(spec).ravel()]


def time_subset(field: DataFrame, spec, nt: int) -> DataFrame:
    which = time_indices(spec, nt)
    return field.where(F.col("t") % which == 0) if isinstance(which, int) else field.where(F.col("t").isin(which))


def select_variables(field: DataFrame, variables) -> DataFrame:
    if isinstance(variables, int):
        variables = [variables]
    if not isinstance(variables, (list, tuple)):
        raise TypeError("variables must be an integer, a list or a tuple")
    return field.where(F.col("v").isin(list(variables)))


def shape_of(field: DataFrame) -> tuple[int, int, int]:
    """(nt, nx, nv) of a dense field; raises if time has gaps or cells are missing."""
    r = field.agg(F.max("t"), F.min("t"), F.max("x"), F.max("v"), F.count("*")).first()
    nt, nx, nv = r[0] + 1, r[2] + 1, r[3] + 1
    if r[1] != 0 or r[4] != nt * nx * nv:
        raise ValueError(f"the field has {r[4]} cells, {nt} x {nx} x {nv} were expected")
    return nt, nx, nv


def flatten_index(field: DataFrame, nv: int) -> DataFrame:
    """k: the space-and-variable index x * nv + v."""
    return field.withColumn("k", F.col("x") * nv + F.col("v"))


def partition_sizes(field: DataFrame) -> DataFrame:
    """Rows of each partition, with the least, the most and the sum over all."""
    sizes = field.groupBy(F.spark_partition_id().alias("part")).count()
    return sizes.agg(F.min("count").alias("least"), F.max("count").alias("most"), F.sum("count").alias("total"))


def by_space(field: DataFrame, parts: int) -> DataFrame:
    """Repartitioned by chunks of space; each chunk keeps its whole time series."""
    return field.repartition(parts, F.pmod("x", F.lit(parts)))

"""Proper orthogonal decomposition by the method of snapshots, or its dual where space is the smaller side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reductions import longtime_mean


def centred(field: DataFrame, mean: DataFrame | None = None) -> DataFrame:
    mean = longtime_mean(field) if mean is None else mean
    return field.join(mean, ["x", "v"]).select("t", "x", "v", (F.col("val") - F.col("mu")).alias("d"))


def gram(field: DataFrame, weights: DataFrame) -> DataFrame:
    """(t1, t2, g) for t1 <= t2: weighted products of snapshots."""
    d = centred(field)
    a = d.join(weights, ["x", "v"]).select("x", "v", "w", F.col("t").alias("t1"), F.col("d").alias("d1"))
    b = d.select("x", "v", F.col("t").alias("t2"), F.col("d").alias("d2"))
    return a.join(b, ["x", "v"]).where("t1 <= t2").groupBy("t1", "t2").agg(F.sum(F.col("d1") * F.col("d2") * F.col("w")).alias("g"))


def _ordered(g: np.ndarray, digits: int | None):
    """(places, values) by ascending value, a part at a time; rounded half away from zero, without negative zero, where digits are given."""
    part, shift = 2**18, max(len(g) - 1, 1).bit_length()
    scaled = None if digits is None else np.abs(g) * 10.0**digits + 0.5
    if scaled is not None and not scaled.max(initial=0.0) < 2.0 ** (62 - shift):  # large, infinite or no numbers
        g, scaled = np.where(scaled < 2.0**52, np.copysign(np.floor(scaled) / 10.0**digits, g), g) + 0.0, None
    if scaled is None:
        order = np.argsort(g)
        for at in (order[j : j + part] for j in range(0, len(g), part)):
            yield at, g[at]
        return
    keys = np.copysign(np.floor(scaled, out=scaled), g, out=scaled).astype(np.int64)
    keys <<= shift
    keys |= np.arange(len(g))
    keys.sort()
    for k in (keys[j : j + part] for j in range(0, len(g), part)):
        yield k & (2**shift - 1), (k >> shift) / 10.0**digits


def gram_chunks(field: DataFrame, weights: DataFrame, side: int = 512, digits: int | None = None) -> DataFrame:
    """gram() for many snapshots: `side` ids at a time form a chunk, and pairs of chunks are multiplied as matrices, so the
    only rows made for a pair of snapshots are its own in the result (which has half the square of their number). The mean and the
    weights are broadcast: a chunk holds `side` snapshots in one row anyway, and the field need not be dealt out by cell to meet them.
    The rows of a pair of chunks are in the order of g, rounded to `digits`: values repeat then, and a Parquet file needs little more
    than the bits of the two ids, instead of 8 bytes for g. The larger `side`, the more they repeat; a task holds a few times 8 bytes
    for each pair of ids of two chunks, and a chunk `side` times the cells, so fields of many cells need a small one."""
    cells = F.array_sort(F.collect_list(F.struct("x", "v", (F.col("d") * F.sqrt("w")).alias("d"))))
    vectors = centred(field, F.broadcast(longtime_mean(field))).join(F.broadcast(weights), ["x", "v"]).groupBy("t").agg(F.transform(cells, lambda c: c["d"]).alias("d"))
    chunks = vectors.groupBy(F.floor(F.col("t") / side).alias("c")).agg(F.collect_list("t").alias("t"), F.flatten(F.collect_list("d")).alias("d"))
    a, b = (chunks.select(*[F.col(k).alias(k + n) for k in ("c", "t", "d")]) for n in "12")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (t1, d1), (t2, d2) = ((batch["t" + n][i].values.to_numpy(), batch["d" + n][i].values.to_numpy()) for n in "12")
                if len(d1) * len(t2) != len(d2) * len(t1):
                    raise ValueError("snapshots differ in their number of cells")
                g = (d1.reshape(len(t1), -1) @ d2.reshape(len(t2), -1).T).ravel()
                for at, values in _ordered(g, digits):
                    u, w = t1[at // len(t2)], t2[at % len(t2)]
                    keep = u <= w
                    yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(w[keep]), pa.array(values[keep])], ["t1", "t2", "g"])

    return a.join(b, F.col("c1") <= F.col("c2")).mapInArrow(run, "t1 long, t2 long, g double")


def spatial_gram(field: DataFrame, weights: DataFrame) -> DataFrame:
    """(i, j, g) for i <= j over cells i = (x, v): the dual matrix with sqrt(w) on both sides."""
    d = centred(field).join(weights, ["x", "v"]).select("t", F.struct("x", "v").alias("c"), (F.col("d") * F.sqrt("w")).alias("d"))
    a, b = d.select("t", F.col("c").alias("i"), F.col("d").alias("d1")), d.select("t", F.col("c").alias("j"), F.col("d").alias("d2"))
    return a.join(b, "t").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("d1") * F.col("d2")).alias("g"))


def _symmetric(rows: list, names: list) -> np.ndarray:
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, g in rows:
        m[at[a], at[b]] = m[at[b], at[a]] = g
    return m


def decompose(field: DataFrame, weights: DataFrame, n_modes: int, nt: int, n_cells: int) -> tuple[DataFrame, DataFrame]:
    """(eigenvalues (m, lam), modes (m, x, v, phi)), largest first; the smaller of the two Gram matrices is diagonalised
    on the driver, so its side is the stated limit."""
    spark = field.sparkSession
    if min(nt, n_cells) > 5_000:
        raise ValueError("both sides of the field exceed 5000; decompose blocks of it")
    import pandas as pd

    if nt <= n_cells:
        rows = gram(field, weights).collect()
        times = np.array(sorted({r.t1 for r in rows}), np.int64)
        m = _symmetric(rows, times.tolist())
        lam, vec = np.linalg.eigh(m)
        lam, vec = lam[::-1][:n_modes], vec[:, ::-1][:, :n_modes]
        good = lam > 1e-12 * max(lam[0], 1e-300)
        lam, vec = lam[good], vec[:, good]
        t, k = np.indices(vec.shape).reshape(2, -1)
        table = spark.createDataFrame(pd.DataFrame({"t": times[t], "m": k.astype(np.int32), "c": vec[t, k] / np.sqrt(lam[k])}), "t long, m int, c double")
        phi = centred(field).join(table, "t").groupBy("m", "x", "v").agg(F.sum(F.col("d") * F.col("c")).alias("phi"))
    else:
        rows = [((i.x, i.v), (j.x, j.v), g) for i, j, g in spatial_gram(field, weights).collect()]
        cells = sorted({r[0] for r in rows})
        lam, vec = np.linalg.eigh(_symmetric(rows, cells))
        lam, vec = lam[::-1][:n_modes], vec[:, ::-1][:, :n_modes]
        good = lam > 1e-12 * max(lam[0], 1e-300)
        lam, vec = lam[good], vec[:, good]
        i, k = np.indices(vec.shape).reshape(2, -1)
        cell = np.array(cells)
        table = spark.createDataFrame(pd.DataFrame({"m": k.astype(np.int32), "x": cell[i, 0].astype(np.int64), "v": cell[i, 1].astype(np.int32), "c": vec[i, k]}), "m int, x long, v int, c double")
        phi = table.join(weights, ["x", "v"]).select("m", "x", "v", F.when(F.col("w") > 0, F.col("c") / F.sqrt("w")).otherwise(0.0).alias("phi"))
    eigs = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(lam)], "m int, lam double")
    return eigs, phi


def coefficients(field: DataFrame, modes: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(m, t, a): projection of the centred field, unweighted unless weights are given."""
    d = centred(field)
    if weights is not None:
        d = d.join(weights, ["x", "v"]).withColumn("d", F.col("d") * F.col("w"))
    return d.join(modes, ["x", "v"]).groupBy("m", "t").agg(F.sum(F.col("d") * F.col("phi")).alias("a"))


def reconstruct(coeffs: DataFrame, modes: DataFrame, mean: DataFrame) -> DataFrame:
    both = modes.join(coeffs, "m").groupBy("t", "x", "v").agg(F.sum(F.col("phi") * F.col("a")).alias("s"))
    return both.join(mean, ["x", "v"]).select("t", "x", "v", (F.col("s") + F.col("mu")).alias("val"))

"""Overlapping blocks of snapshots, their preprocessing, and discrete Fourier transforms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import hamming, turn
from ..plans.params import SpodParams
from .reductions import block_mean, block_variance, longtime_mean


def hamming_table(spark: SparkSession, p: SpodParams) -> DataFrame:
    return spark.range(p.n_dft).select(F.col("id").cast("int").alias("n"), hamming(F.col("id"), p.n_dft).alias("w"))


def frequency_axis(spark: SparkSession, p: SpodParams) -> DataFrame:
    """(f, freq) of the bins that are kept."""
    step = F.lit(p.n_dft * p.time_step)
    k = F.col("id")
    freq = k / step
    if p.complex_data and not p.fullspectrum:
        freq = F.when(2 * k >= p.n_dft, freq - F.lit(1 / p.time_step)).otherwise(freq)
    return spark.range(p.n_freq).select(k.cast("int").alias("f"), freq.alias("freq"))


def block_offsets(spark: SparkSession, p: SpodParams, nt: int) -> DataFrame:
    return spark.range(p.n_blocks(nt)).select(F.col("id").cast("int").alias("b"), (F.col("id") * p.step).alias("offset"))


def segment(field: DataFrame, p: SpodParams, nt: int) -> DataFrame:
    """(b, n, x, v, val): every block that holds a snapshot is computed from t, so there is no range join and no shuffle."""
    last = p.n_blocks(nt) - 1
    lo = F.greatest(F.lit(0), F.ceil((F.col("t") - p.n_dft + 1) / p.step)).cast("int")
    hi = F.least(F.lit(last), F.floor(F.col("t") / p.step)).cast("int")
    inside = field.where(F.col("t") < last * p.step + p.n_dft).withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    return inside.select(F.explode(F.sequence("lo", "hi")).alias("b"), "t", "x", "v", "val").select("b", (F.col("t") - F.col("b") * p.step).cast("int").alias("n"), "x", "v", "val")


def preprocess(field: DataFrame, p: SpodParams, nt: int, mean: DataFrame | None = None) -> DataFrame:
    """Blocks without their mean, over their variance if asked for, tapered."""
    if p.mean_type == "longtime":
        mean = longtime_mean(field) if mean is None else mean
        field = field.join(mean, ["x", "v"]).withColumn("val", F.col("val") - F.col("mu")).drop("mu")
    blocks = segment(field, p, nt)
    if p.mean_type == "blockwise":
        blocks = blocks.join(block_mean(blocks), ["b", "x", "v"]).withColumn("val", F.col("val") - F.col("mu")).drop("mu")
    if p.normalize_data:
        blocks = blocks.join(block_variance(blocks), ["b", "x", "v"]).withColumn("val", F.col("val") / F.col("var")).drop("var")
    return blocks.withColumn("val", F.col("val") * hamming(F.col("n"), p.n_dft))


def dft(tapered: DataFrame, p: SpodParams) -> DataFrame:
    """(f, b, x, v, re, im) as sums over a twiddle expression: plain aggregation, best for short blocks."""
    every = F.explode(F.sequence(F.lit(0), F.lit(p.n_freq - 1)))
    rows = tapered.select("b", "n", "x", "v", "val", every.alias("f"))
    angle, scale = turn(F.col("f"), F.col("n"), p.n_dft), p.gain / p.n_dft
    return rows.groupBy("f", "b", "x", "v").agg((F.sum(F.col("val") * F.cos(angle)) * F.lit(scale)).alias("re"), (F.sum(-F.col("val") * F.sin(angle)) * F.lit(scale)).alias("im"))


def dft_fast(tapered: DataFrame, p: SpodParams) -> DataFrame:
    """The same by FFT: the n_dft values of a block and cell are gathered, transformed in Arrow batches and spread again."""
    arrays = tapered.groupBy("b", "x", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "val"))), lambda s: s["val"]).alias("vals"))
    n_dft, n_freq, scale, one_sided = p.n_dft, p.n_freq, p.gain / p.n_dft, p.one_sided

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vals = batch["vals"].flatten().to_numpy(zero_copy_only=False).reshape(-1, n_dft)
            q = scale * (np.fft.rfft(vals, axis=1) if one_sided else np.fft.fft(vals, axis=1)[:, :n_freq])
            m = len(vals)
            index = np.repeat(np.arange(m), n_freq)
            take = pa.array(index)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(n_freq, dtype=np.int32), m)), batch["b"].take(take), batch["x"].take(take), batch["v"].take(take), pa.array(q.real.ravel()), pa.array(q.imag.ravel())],
                ["f", "b", "x", "v", "re", "im"],
            )

    return arrays.mapInArrow(run, "f int, b int, x long, v int, re double, im double")


def spectra(field: DataFrame, p: SpodParams, nt: int, mean: DataFrame | None = None) -> DataFrame:
    """Fourier realizations of all blocks; the transform is chosen by block length."""
    tapered = preprocess(field, p, nt, mean)
    return dft_fast(tapered, p) if p.n_dft > 32 else dft(tapered, p)


def sliding_spectra(field: DataFrame, p: SpodParams, nt: int, bins: list[int]) -> DataFrame:
    """(f, t, x, v, re, im): the windowed transform centred on every snapshot of a mean-free field, zero-padded by half a
    block at both ends and corrected there for the part of the window that holds data."""
    half, w = math.ceil(p.n_dft / 2), p.window
    whole = sum(w)
    corr = []
    for i in range(nt):
        if i < half - 2:
            corr.append(math.sqrt(whole / sum(w[half - i - 1 :])))
        elif i >= nt - half:
            corr.append(math.sqrt(whole / sum(w[: nt + half - i - 1])))
        else:
            corr.append(1.0)
    edges = {i: c for i, c in enumerate(corr) if c != 1.0}  # at most one block's worth of entries
    place = F.create_map(*[F.lit(z) for i, c in edges.items() for z in (i, c)])[F.col("i")] if edges else F.lit(None)
    # Snapshot t sits at n = t + half - i of window i.
    rows = field.select(F.explode(F.sequence(F.greatest(F.lit(0), F.col("t") + half - p.n_dft + 1), F.least(F.lit(nt - 1), F.col("t") + half))).alias("i"), "t", "x", "v", "val")
    rows = rows.withColumn("n", F.col("t") + half - F.col("i"))
    rows = rows.withColumn("val", F.col("val") * hamming(F.col("n"), p.n_dft)).withColumn("f", F.explode(F.array(*[F.lit(b) for b in bins])))
    angle = turn(F.col("f"), F.col("n"), p.n_dft)
    summed = rows.groupBy("f", "i", "x", "v").agg(F.sum(F.col("val") * F.cos(angle)).alias("re"), F.sum(-F.col("val") * F.sin(angle)).alias("im"))
    c = F.coalesce(place, F.lit(1.0))
    return summed.select("f", F.col("i").alias("t"), "x", "v", (F.col("re") * c).alias("re"), (F.col("im") * c).alias("im"))


def energy_spectrum(series: DataFrame, n: int) -> DataFrame:
    """(k, e) of a series (t, u): half the squared real part of the scaled transform, folded; bin 0 is 0."""
    rows = series.select("t", "u", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    e = rows.groupBy("k").agg((F.sum(F.col("u") * F.cos(turn(F.col("k"), F.col("t"), n))) / n).alias("re")).select("k", (0.5 * F.col("re") * F.col("re")).alias("e"))
    mirror = e.select((n - F.col("k")).alias("k"), F.col("e").alias("other"))
    half = n // 2
    both = e.where(F.col("k") < half).join(mirror, "k", "left")
    return both.select("k", F.when(F.col("k") == 0, 0.0).otherwise(0.5 * (F.col("e") + F.col("other"))).alias("e"))

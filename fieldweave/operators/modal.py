"""Cross-spectral Gram matrices, eigenpairs, modes, coefficients and reconstruction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import cmul, cmul_conj, confidence_factors
from ..plans.params import SpodParams

#: Modes with a smaller share of the largest eigenvalue are dropped.
RELATIVE_TOL = 1e-12


def gram(qhat: DataFrame, weights: DataFrame, n_blocks: int) -> DataFrame:
    """(f, b1, b2, re, im) for b1 <= b2, by a self-join on (f, x, v): readable and checkable; see gram_partial for large fields."""
    w = qhat.join(weights, ["x", "v"])
    a = w.select("f", "x", "v", "w", F.col("b").alias("b1"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = qhat.select("f", "x", "v", F.col("b").alias("b2"), F.col("re").alias("br"), F.col("im").alias("bi"))
    re, im = cmul_conj(F.col("ar"), F.col("ai"), F.col("br"), F.col("bi"))
    both = a.join(b, ["f", "x", "v"]).where("b1 <= b2")
    return both.groupBy("f", "b1", "b2").agg((F.sum(re * F.col("w")) / n_blocks).alias("re"), (F.sum(im * F.col("w")) / n_blocks).alias("im"))


def gram_partial(qhat: DataFrame, weights: DataFrame, n_blocks: int, parts: int = 64) -> DataFrame:
    """The same without pairs of rows: chunks of space of one frequency stream by in order, each task adds outer
    products into one matrix at a time, and only matrices meet in the last sum."""
    rows = qhat.join(weights, ["x", "v"]).withColumn("chunk", F.pmod("x", F.lit(parts)))
    rows = rows.repartition("f", "chunk").sortWithinPartitions("f", "x", "v").select("f", "b", "x", "v", "re", "im", "w")
    upper = np.triu_indices(n_blocks)

    def run(batches):
        now, m, cell, vec, weight = None, None, None, None, 0.0

        def add():
            nonlocal m
            m += weight * np.outer(vec.conj(), vec)

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), now, np.int32)), pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(m[upper].real.copy()), pa.array(m[upper].imag.copy())], ["f", "b1", "b2", "re", "im"])

        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("f", "x", "v", "b", "re", "im", "w")]
            for f, x, v, b, re, im, w in zip(*cols):
                if (f, x, v) != cell:
                    if cell is not None:
                        add()
                    if f != now:
                        if now is not None:
                            yield emit()
                        now, m = f, np.zeros((n_blocks, n_blocks), complex)
                    cell, vec, weight = (f, x, v), np.zeros(n_blocks, complex), w
                vec[b] = complex(re, im)
        if cell is not None:
            add()
            yield emit()

    part = rows.mapInArrow(run, "f int, b1 int, b2 int, re double, im double")
    return part.groupBy("f", "b1", "b2").agg((F.sum("re") / n_blocks).alias("re"), (F.sum("im") / n_blocks).alias("im"))


def traces(gram_: DataFrame) -> DataFrame:
    return gram_.where("b1 = b2").groupBy("f").agg(F.sum("re").alias("trace"))


def frobenius(gram_: DataFrame) -> DataFrame:
    """(f, fro2): squared Frobenius norm from the upper half."""
    size = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return gram_.groupBy("f").agg(F.sum(F.when(F.col("b1") == F.col("b2"), size).otherwise(2 * size)).alias("fro2"))


def eigen(gram_: DataFrame, n_blocks: int) -> DataFrame:
    """(f, m, b, lam, vre, vim): eigenpairs of each frequency's Hermitian matrix, largest first; frequencies go in parallel."""

    def run(pdf):
        import pandas as pd

        a = np.zeros((n_blocks, n_blocks), complex)
        a[pdf.b1, pdf.b2] = pdf.re + 1j * pdf.im
        a = a + np.triu(a, 1).conj().T
        lam, vec = np.linalg.eigh(a)
        lam, vec = np.clip(lam[::-1], 0, None), vec[:, ::-1]
        m, b = np.indices((n_blocks, n_blocks)).reshape(2, -1)
        return pd.DataFrame({"f": np.int32(pdf.f.iloc[0]), "m": m.astype(np.int32), "b": b.astype(np.int32), "lam": lam[m], "vre": vec[b, m].real, "vim": vec[b, m].imag})

    return gram_.groupBy("f").applyInPandas(run, "f int, m int, b int, lam double, vre double, vim double")


def eigenvalues(pairs: DataFrame, p: SpodParams, n_blocks: int) -> DataFrame:
    """(f, freq, m, lam, lam_lo, lam_hi): energies, interior bins of one-sided spectra doubled, with chi-squared bounds."""
    lo, hi = confidence_factors(n_blocks, p.conf_level)
    double = not p.complex_data and (p.one_sided or p.double_fullspectrum)
    lam = F.when((F.col("f") > 0) & (F.col("f") < p.n_freq - 1), 2 * F.col("lam")).otherwise(F.col("lam")) if double else F.col("lam")
    freq = F.col("f") / F.lit(p.n_dft * p.time_step)
    if p.complex_data and not p.fullspectrum:
        freq = F.when(2 * F.col("f") >= p.n_dft, freq - F.lit(1 / p.time_step)).otherwise(freq)
    return pairs.where("b = 0").select("f", freq.alias("freq"), "m", lam.alias("lam")).withColumns({"lam_lo": F.col("lam") * lo, "lam_hi": F.col("lam") * hi})


def modes(qhat: DataFrame, pairs: DataFrame, n_blocks: int, n_modes: int | None = None) -> DataFrame:
    """(f, m, x, v, re, im): orthonormal in the weighted inner product; truncation comes before the join."""
    keep = pairs.where(F.col("m") < (n_blocks if n_modes is None else n_modes))
    top = pairs.where("m = 0 and b = 0").select("f", F.col("lam").alias("top"))
    keep = keep.join(top, "f").where(F.col("lam") > RELATIVE_TOL * F.col("top")).select("f", "m", "b", (F.col("vre") / F.sqrt(F.col("lam") * n_blocks)).alias("vr"), (F.col("vim") / F.sqrt(F.col("lam") * n_blocks)).alias("vi"))
    re, im = cmul(F.col("re"), F.col("im"), F.col("vr"), F.col("vi"))
    return qhat.join(keep, ["f", "b"]).groupBy("f", "m", "x", "v").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def inner_products(left: DataFrame, right: DataFrame, weights: DataFrame) -> DataFrame:
    """One row (re, im): sum of conj(left) * w * right over (x, v)."""
    a = left.select("x", "v", F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = right.select("x", "v", F.col("re").alias("br"), F.col("im").alias("bi"))
    re, im = cmul_conj(F.col("ar"), F.col("ai"), F.col("br"), F.col("bi"))
    both = a.join(b, ["x", "v"]).join(weights, ["x", "v"])
    return both.agg(F.sum(re * F.col("w")).alias("re"), F.sum(im * F.col("w")).alias("im"))


def orthogonality(modes_: DataFrame, weights: DataFrame, f: int, m1: int, m2: int, tol: float = 2e-6) -> DataFrame:
    """(re, im, ok): whether the product of two modes is 1 (the same mode) or 0."""
    one = modes_.where((F.col("f") == f) & (F.col("m") == m1))
    two = modes_.where((F.col("f") == f) & (F.col("m") == m2))
    expected = 1.0 if m1 == m2 else 0.0
    out = inner_products(one, two, weights)
    return out.withColumn("ok", (F.abs(F.col("re") - expected) < tol) & (F.abs("im") < tol))


def band(p: SpodParams, t_lb: float | None = None, t_ub: float | None = None) -> tuple[int, int]:
    """First and last bin of a range of periods; all bins without one."""
    freq = p.frequencies()
    nearest = lambda x: min(range(len(freq)), key=lambda k: (abs(freq[k] - x), k))
    return (0 if t_ub is None else nearest(1 / t_ub)), (len(freq) - 1 if t_lb is None else nearest(1 / t_lb))


def numbered(modes_: DataFrame, lo: int, hi: int, n_modes: int, modes_idx: list[int] | None = None) -> DataFrame:
    """Modes of a band with their row number k = (f - lo) * n_modes + m."""
    keep = modes_.where((F.col("f") >= lo) & (F.col("f") <= hi) & (F.col("m") < n_modes))
    if modes_idx is not None:
        keep = keep.where(F.col("m").isin(list(modes_idx)))
    return keep.withColumn("k", (F.col("f") - lo) * n_modes + F.col("m"))


def oblique_coefficients(field: DataFrame, modes_k: DataFrame, weights: DataFrame, mean: DataFrame, tol: float = 1e-10, svd: bool = False) -> DataFrame:
    """(k, t, re, im) = pinv(Phi^H W Phi) Phi^H W (X - mean). Only the K x K matrix of the chosen modes reaches the driver."""
    spark = field.sparkSession
    a = modes_k.join(weights, ["x", "v"]).select("x", "v", "w", F.col("k").alias("k1"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = modes_k.select("x", "v", F.col("k").alias("k2"), F.col("re").alias("br"), F.col("im").alias("bi"))
    re, im = cmul_conj(F.col("ar"), F.col("ai"), F.col("br"), F.col("bi"))
    rows = a.join(b, ["x", "v"]).where("k1 <= k2").groupBy("k1", "k2").agg(F.sum(re * F.col("w")).alias("re"), F.sum(im * F.col("w")).alias("im")).collect()
    ks = sorted({r.k1 for r in rows})
    at = {k: i for i, k in enumerate(ks)}
    m = np.zeros((len(ks), len(ks)), complex)
    for r in rows:
        m[at[r.k1], at[r.k2]] = complex(r.re, r.im)
        m[at[r.k2], at[r.k1]] = complex(r.re, -r.im)
    if svd:
        u, s, vh = np.linalg.svd(m)
        keep = s > tol * s[0] if len(s) else s > 0
        inv = (vh.conj().T[:, keep] / s[keep]) @ u.conj().T[keep]
    else:
        inv = np.linalg.pinv(m, tol)
    # Rows of pinv(M) Phi^H are formed once per cell, so the field is read and summed once.
    import pandas as pd

    i, j = np.indices(inv.shape).reshape(2, -1)
    table = spark.createDataFrame(pd.DataFrame({"k": np.array(ks, np.int32)[i], "j": np.array(ks, np.int32)[j], "pr": inv[i, j].real, "pi": inv[i, j].imag}), "k int, j int, pr double, pi double")
    re, im = cmul(F.col("pr"), F.col("pi"), F.col("re"), -F.col("im"))
    dual = modes_k.select(F.col("k").alias("j"), "x", "v", "re", "im").join(table, "j").groupBy("k", "x", "v").agg(F.sum(re).alias("dr"), F.sum(im).alias("di")).join(weights, ["x", "v"])
    centred = field.join(mean, ["x", "v"]).select("t", "x", "v", (F.col("val") - F.col("mu")).alias("d"))
    return centred.join(dual, ["x", "v"]).groupBy("k", "t").agg(F.sum(F.col("dr") * F.col("w") * F.col("d")).alias("re"), F.sum(F.col("di") * F.col("w") * F.col("d")).alias("im"))


def convolution_coefficients(sliding: DataFrame, modes_: DataFrame, weights: DataFrame) -> DataFrame:
    """(f, m, t, re, im): the sliding transform projected on each frequency's modes."""
    a = modes_.join(weights, ["x", "v"]).select("f", "m", "x", "v", "w", F.col("re").alias("ar"), F.col("im").alias("ai"))
    re, im = cmul_conj(F.col("ar"), F.col("ai"), F.col("re"), F.col("im"))
    return sliding.join(a, ["f", "x", "v"]).groupBy("f", "m", "t").agg(F.sum(re * F.col("w")).alias("re"), F.sum(im * F.col("w")).alias("im"))


def reconstruct(coefficients: DataFrame, modes_k: DataFrame, mean: DataFrame) -> DataFrame:
    """(t, x, v, re, im) = Phi a + mean; a: (k, t, re, im)."""
    a = coefficients.select("k", "t", F.col("re").alias("ar"), F.col("im").alias("ai"))
    re, im = cmul(F.col("re"), F.col("im"), F.col("ar"), F.col("ai"))
    summed = modes_k.select("k", "x", "v", "re", "im").join(a, "k").groupBy("t", "x", "v").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    return summed.join(mean, ["x", "v"]).select("t", "x", "v", (F.col("re") + F.col("mu")).alias("re"), "im")


def reconstruct_convolution(coefficients: DataFrame, modes_: DataFrame, mean: DataFrame) -> DataFrame:
    """The same for coefficients (f, m, t, re, im)."""
    key = F.struct("f", "m")
    return reconstruct(coefficients.select(key.alias("k"), "t", "re", "im"), modes_.select(key.alias("k"), "x", "v", "re", "im"), mean)


def fix_phase(modes_: DataFrame) -> DataFrame:
    """Each mode turned so that its largest entry (the first cell on near ties) is real and positive."""
    size = F.round(F.hypot("re", "im"), 9)
    lead = modes_.groupBy("f", "m").agg(F.max_by(F.struct("re", "im"), F.struct(size, -F.col("x"), -F.col("v"))).alias("p"))
    r = F.hypot("p.re", "p.im")
    re, im = cmul_conj(F.col("p.re") / r, F.col("p.im") / r, F.col("re"), F.col("im"))
    return modes_.join(F.broadcast(lead), ["f", "m"]).select("f", "m", "x", "v", re.alias("re"), im.alias("im"))

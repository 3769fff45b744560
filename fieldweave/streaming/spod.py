"""Streaming spectral decomposition: snapshots update partial transforms and a low-rank basis per frequency."""

from __future__ import annotations

import math
import pickle

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import hamming, turn
from ..operators.reductions import running_mean
from ..plans.params import SpodParams


def lanes(p: SpodParams) -> int:
    return math.ceil(p.n_dft / p.step)


def schedule(p: SpodParams, nt: int, kind: str = "reference") -> list[tuple[int, int]]:
    """(k, start) of the blocks completed within nt snapshots, k from 1 in order of completion. In the reference's schedule
    a lane rests one snapshot between blocks; 'aligned' starts every `step` snapshots."""
    n, dn = lanes(p), p.step
    period = n * dn + (1 if kind == "reference" else 0)
    starts = sorted(j * dn + g * period for j in range(n) for g in range(nt // period + 1))
    return [(k + 1, s) for k, s in enumerate(s for s in starts if s + p.n_dft <= nt)]


def block_spectra(field: DataFrame, p: SpodParams, nt: int, kind: str = "reference") -> DataFrame:
    """(k, f, x, v, re, im) as streaming sees them: the running mean at a block's last snapshot is removed; interior bins of
    real data count twice. The batch replay of the stream."""
    spark, n_dft = field.sparkSession, p.n_dft
    blocks = spark.createDataFrame(schedule(p, nt, kind), "k int, start int")
    members = blocks.select("k", "start", F.explode(F.sequence(F.lit(0), F.lit(n_dft - 1))).alias("n")).select("k", "n", (F.col("start") + F.col("n")).cast("long").alias("t"), (F.col("start") + n_dft - 1).cast("long").alias("last"))
    at_end = running_mean(field).select(F.col("t").alias("last"), "x", "v", "mu")
    rows = field.join(F.broadcast(members), "t").join(at_end.join(F.broadcast(members.select("last").distinct()), "last", "left_semi"), ["last", "x", "v"])
    rows = rows.select("k", "n", "x", "v", ((F.col("val") - F.col("mu")) * hamming(F.col("n"), n_dft)).alias("val"), F.explode(F.sequence(F.lit(0), F.lit(p.n_freq - 1))).alias("f"))
    angle = turn(F.col("f"), F.col("n"), n_dft)
    double = F.when((F.col("f") > 0) & (F.col("f") < p.n_freq - 1), 2.0).otherwise(1.0) if p.one_sided else F.lit(1.0)
    scale = F.lit(p.gain / n_dft) * double
    return rows.groupBy("k", "f", "x", "v").agg(F.sum(F.col("val") * F.cos(angle)).alias("re"), F.sum(-F.col("val") * F.sin(angle)).alias("im")).select("k", "f", "x", "v", (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))


class State:
    """Running mean, partial transforms and basis of some frequencies; advances one snapshot at a time."""

    def __init__(self, p: SpodParams, bins: list[int], root_w: np.ndarray, rank: int, kind: str = "reference"):
        self.p, self.bins, self.rank, self.kind = p, bins, rank, kind
        self.root_w, self.n, self.blocks, self.late = root_w, 0, 0, 0
        size = len(root_w)
        self.mean = np.zeros(size)
        self.sums = np.zeros((lanes(p), len(bins), size), complex)
        self.window = np.array(p.window)
        k = np.outer(bins, np.arange(p.n_dft)) % p.n_dft
        double = np.array([2.0 if p.one_sided and 0 < f < p.n_freq - 1 else 1.0 for f in bins])
        self.wave = np.exp(-2j * np.pi * k / p.n_dft) * double[:, None]
        self.u = [np.zeros((size, 0), complex) for _ in bins]
        self.s = [np.zeros(0) for _ in bins]

    def add(self, t: int, x: np.ndarray) -> None:
        """Snapshots come in order; one that comes late is counted and left out."""
        if t < self.n:
            self.late += 1
            return
        self.mean = (self.n * self.mean + x) / (self.n + 1)
        period = lanes(self.p) * self.p.step + (1 if self.kind == "reference" else 0)
        for j in range(lanes(self.p)):
            rel = self.n - j * self.p.step
            n = rel % period if rel >= 0 else -1
            if 0 <= n < self.p.n_dft:
                if n == 0:
                    self.sums[j] = 0
                self.sums[j] += (self.window[n] * self.wave[:, n])[:, None] * x
                if n == self.p.n_dft - 1:
                    self._complete(j)
        self.n += 1

    def _complete(self, j: int) -> None:
        self.blocks += 1
        b = self.blocks
        flat = self.wave @ self.window
        hat = (self.sums[j] - flat[:, None] * self.mean) * (self.p.gain / self.p.n_dft) * self.root_w
        for i, x in enumerate(hat):
            u, s = self.u[i], self.s[i]
            ux = u.conj().T @ x
            rest = x - u @ ux
            again = u.conj().T @ rest  # a second pass keeps the basis orthogonal
            ux, rest = ux + again, rest - u @ again
            size = float(np.linalg.norm(rest))
            new = size > 1e-10 * max(float(np.linalg.norm(x)), 1e-300)
            k = np.zeros((len(s) + new, len(s) + 1), complex)
            k[: len(s), : len(s)] = math.sqrt(b + 2) * np.diag(s)
            k[: len(s), -1] = ux
            if new:
                k[-1, -1] = size
                u = np.column_stack([u, rest / size])
            if not len(k):
                continue
            up, sp, _ = np.linalg.svd(math.sqrt(b + 1) / (b + 2) * k, full_matrices=False)
            self.u[i], self.s[i] = (u @ up)[:, : self.rank], sp[: self.rank]

    def modes(self, i: int) -> np.ndarray:
        """Weighted-orthonormal modes; cells of weight 0 hold 0."""
        w = self.root_w[:, None]
        return np.divide(self.u[i], w, out=np.zeros_like(self.u[i]), where=w > 0)


_OUT = "f int, m int, sigma double, blocks int, late int, x long, v int, re double, im double"


def _rows(state: State, nv: int):
    import pandas as pd

    parts = []
    for i, f in enumerate(state.bins):
        phi = state.modes(i)
        c, m = np.indices(phi.shape).reshape(2, -1)
        parts.append(pd.DataFrame({"f": np.int32(f), "m": m.astype(np.int32), "sigma": state.s[i][m], "blocks": np.int32(state.blocks), "late": np.int32(state.late), "x": (c // nv).astype(np.int64), "v": (c % nv).astype(np.int32), "re": phi[c, m].real, "im": phi[c, m].imag}))
    return pd.concat(parts)


def _advance(state: State, pdf, nv: int) -> None:
    size = len(state.root_w)
    for t, rows in pdf.sort_values("t", kind="stable").groupby("t", sort=True):
        x = np.zeros(size)
        x[rows.x.to_numpy() * nv + rows.v.to_numpy()] = rows.val.to_numpy()
        state.add(int(t), x)


def _spread(field: DataFrame, groups: int) -> DataFrame:
    """Every snapshot goes to each group of frequencies, a fixed small number of times."""
    return field.select("t", "x", "v", "val", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))


def replay(field: DataFrame, p: SpodParams, weights: list[float], nv: int = 1, rank: int | None = None, groups: int = 4, kind: str = "reference") -> DataFrame:
    """The stream's final state from a batch of snapshots, groups of frequencies in parallel."""
    rank, root = rank or len(weights), np.sqrt(np.array(weights, float))

    def run(key, pdf):
        state = State(p, [f for f in range(p.n_freq) if f % groups == int(key[0])], root, rank, kind)
        _advance(state, pdf, nv)
        return _rows(state, nv)

    return _spread(field, groups).groupBy("g").applyInPandas(run, _OUT)


def stream(snapshots: DataFrame, p: SpodParams, weights: list[float], nv: int = 1, rank: int | None = None, groups: int = 4, kind: str = "reference") -> DataFrame:
    """A streaming DataFrame of the basis after each micro-batch; write it in update mode. Snapshots (t, x, v, val) must be
    whole within a micro-batch. State lives in Spark's state store, keyed by frequency group."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    rank, root = rank or len(weights), np.sqrt(np.array(weights, float))

    def run(key, pdfs, state):
        import pandas as pd

        now = pickle.loads(state.get[0]) if state.exists else State(p, [f for f in range(p.n_freq) if f % groups == int(key[0])], root, rank, kind)
        _advance(now, pd.concat(list(pdfs)), nv)
        state.update((pickle.dumps(now),))
        yield _rows(now, nv)

    return _spread(snapshots, groups).groupBy("g").applyInPandasWithState(run, _OUT, "state binary", "update", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame) -> DataFrame:
    """Of updates written by a stream, the last state of each frequency."""
    w = Window.partitionBy("f")
    return rows.withColumn("top", F.max("blocks").over(w)).where("blocks = top").drop("top").distinct()

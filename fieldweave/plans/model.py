"""Fitted models: batch SPOD, streaming SPOD and POD over fields, with results as Parquet tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, fields, modal, pod, reductions, weights as weighting
from ..streaming import spod as streaming
from .params import SpodParams


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class _Base:
    nt = nx = nv = 0
    mean: DataFrame
    weights: DataFrame

    def _sizes(self, field: DataFrame, weights: DataFrame | None) -> None:
        self.nt, self.nx, self.nv = fields.shape_of(field)
        spark = field.sparkSession
        self.weights = weighting.uniform(spark, self.nx, self.nv) if weights is None else weighting.custom(weights, self.nx, self.nv)
        self.mean = reductions.longtime_mean(field)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.nt, self.nx, self.nv


class SpectralPOD(_Base):
    """fit() gives eigenvalues (f, freq, m, lam, lam_lo, lam_hi) and modes (f, m, x, v, re, im)."""

    def __init__(self, params: SpodParams):
        self.params = params

    def fit(self, field: DataFrame, weights: DataFrame | None = None, cache: str | None = None) -> SpectralPOD:
        """cache: a folder where block transforms are kept (savefft) and taken from (reuse_blocks)."""
        p, spark = self.params, field.sparkSession
        self._sizes(field, weights)
        if p.normalize_weights:
            self.weights = weighting.normalized(self.weights, field)
        self.n_blocks = p.n_blocks(self.nt)
        path = f"{cache}/{self.run_key()}/qhat" if cache else None
        if path and p.reuse_blocks and _exists(spark, path):
            self.qhat = spark.read.parquet(path)
        else:
            self.qhat = blocks.spectra(field, p, self.nt, self.mean)
            if path and p.savefft:
                self.qhat.write.mode("overwrite").parquet(path)
                self.qhat = spark.read.parquet(path)
            else:
                self.qhat = self.qhat.persist()
        small = self.n_blocks**2 * p.n_freq * self.nx * self.nv <= 5_000_000
        self.gram = (modal.gram if small else modal.gram_partial)(self.qhat, self.weights, self.n_blocks)
        self.pairs = modal.eigen(self.gram, self.n_blocks).persist()
        self.eigs = modal.eigenvalues(self.pairs, p, self.n_blocks)
        self.modes = modal.modes(self.qhat, self.pairs, self.n_blocks, p.n_modes_save)
        return self

    def run_key(self) -> str:
        """Names a folder of results: sizes to read, and a hash of all parameters and the field's shape. Fields of one shape need caches of
        their own, as the key doesn't see their values."""
        p = self.params
        kept = hashlib.sha256(json.dumps([p.to_dict(), *self.shape], sort_keys=True, default=str).encode()).hexdigest()[:12]
        return f"nfft{p.n_dft}_novlp{p.n_overlap}_nblks{p.n_blocks(self.nt)}_{kept}"

    @property
    def n_modes(self) -> int:
        return min(self.params.n_modes_save or self.n_blocks, self.n_blocks)

    @property
    def frequencies(self) -> list[float]:
        return self.params.frequencies()

    def modes_at(self, f: int) -> DataFrame:
        return self.modes.where(F.col("f") == f)

    def coefficients(self, field: DataFrame, t_lb: float | None = None, t_ub: float | None = None, modes_idx=None, tol: float = 1e-10, svd: bool = True) -> DataFrame:
        """Oblique projection of a field, whose own mean is removed, on the modes of a range of periods."""
        lo, hi = modal.band(self.params, t_lb, t_ub)
        self.band_modes = modal.numbered(self.modes, lo, hi, self.n_modes, modes_idx).persist()
        self.coeff_mean = reductions.longtime_mean(field)
        self.coeffs = modal.oblique_coefficients(field, self.band_modes, self.weights, self.coeff_mean, tol, svd)
        return self.coeffs

    def coefficients_by_convolution(self, field: DataFrame, t_lb: float | None = None, t_ub: float | None = None) -> DataFrame:
        lo, hi = modal.band(self.params, t_lb, t_ub)
        self.coeff_mean = reductions.longtime_mean(field)
        centred = field.join(self.coeff_mean, ["x", "v"]).select("t", "x", "v", (F.col("val") - F.col("mu")).alias("val"))
        sliding = blocks.sliding_spectra(centred, self.params, self.nt, list(range(lo, hi + 1)))
        return modal.convolution_coefficients(sliding, self.modes.where(F.col("f").between(lo, hi)), self.weights)

    def reconstruct(self, time_idx=None) -> DataFrame:
        """From the last coefficients: (t, x, v, re, im) at the chosen snapshots."""
        if not hasattr(self, "coeffs"):
            raise RuntimeError("compute coefficients first")
        return modal.reconstruct(fields.time_subset(self.coeffs, time_idx, self.nt), self.band_modes, self.coeff_mean)

    def save(self, path: str) -> None:
        """Tables below path/run_key: eigs, modes (by frequency), weights, mean; and the parameters."""
        root = f"{path}/{self.run_key()}"
        self.eigs.write.mode("overwrite").parquet(f"{root}/eigs")
        # A frequency's modes go to as many tasks as they fill.
        parts = max(1, self.nx * self.nv * self.n_modes // 5_000_000)
        self.modes.repartition(F.col("f"), F.pmod(F.xxhash64("x", "v"), F.lit(parts))).write.mode("overwrite").partitionBy("f").parquet(f"{root}/modes")
        self.weights.write.mode("overwrite").parquet(f"{root}/weights")
        self.mean.write.mode("overwrite").parquet(f"{root}/mean")
        meta = self.params.to_dict() | {"nt": self.nt, "nx": self.nx, "nv": self.nv, "n_blocks": self.n_blocks}
        self.eigs.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{root}/params")

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> SpectralPOD:
        if not _exists(spark, f"{root}/params"):
            raise FileNotFoundError(f"{root} holds no fitted model")
        meta = json.loads(spark.read.text(f"{root}/params").first()[0])
        self = cls(SpodParams.from_dict(meta))
        self.nt, self.nx, self.nv, self.n_blocks = (meta[k] for k in ("nt", "nx", "nv", "n_blocks"))
        self.eigs, self.weights, self.mean = (spark.read.parquet(f"{root}/{t}") for t in ("eigs", "weights", "mean"))
        self.modes = spark.read.parquet(f"{root}/modes").select("f", "m", "x", "v", "re", "im")
        return self

    def describe(self) -> str:
        return f"{self.params.describe()}\nsnapshots, cells, variables  {self.shape}\nblocks  {self.n_blocks}"


class StreamingPOD(_Base):
    """The streaming algorithm, over a batch replay or a stream of snapshots."""

    def __init__(self, params: SpodParams, schedule: str = "reference", rank: int | None = None):
        self.params, self.schedule, self.rank = params, schedule, rank

    def fit(self, field: DataFrame, weights: list[float], nv: int = 1) -> StreamingPOD:
        run = streaming.stream if field.isStreaming else streaming.replay
        self.modes = run(field, self.params, weights, nv, self.rank, kind=self.schedule)
        return self


class SnapshotPOD(_Base):
    """Proper orthogonal decomposition: eigs (m, lam), modes (m, x, v, phi)."""

    def __init__(self, n_modes: int = 10):
        self.n_modes = n_modes

    def fit(self, field: DataFrame, weights: DataFrame | None = None) -> SnapshotPOD:
        self._sizes(field, weights)
        self.eigs, self.modes = pod.decompose(field, self.weights, self.n_modes, self.nt, self.nx * self.nv)
        return self

    def coefficients(self, field: DataFrame, weighted: bool = False) -> DataFrame:
        self.coeffs = pod.coefficients(field, self.modes, self.weights if weighted else None)
        return self.coeffs

    def reconstruct(self, time_idx=None) -> DataFrame:
        return pod.reconstruct(fields.time_subset(self.coeffs, time_idx, self.nt), self.modes, self.mean)

    def save(self, path: str) -> None:
        """Tables below path: eigs, modes, weights, mean, the coefficients if there are any; and the sizes."""
        for name in ("eigs", "modes", "weights", "mean", "coeffs"):
            if hasattr(self, name):
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        meta = {"n_modes": self.n_modes, "nt": self.nt, "nx": self.nx, "nv": self.nv}
        self.eigs.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SnapshotPOD:
        if not _exists(spark, f"{path}/params"):
            raise FileNotFoundError(f"{path} holds no fitted model")
        meta = json.loads(spark.read.text(f"{path}/params").first()[0])
        self = cls(meta["n_modes"])
        self.nt, self.nx, self.nv = (meta[k] for k in ("nt", "nx", "nv"))
        for name in ("eigs", "modes", "weights", "mean", "coeffs"):
            if _exists(spark, f"{path}/{name}"):
                setattr(self, name, spark.read.parquet(f"{path}/{name}"))
        return self

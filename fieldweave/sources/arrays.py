"""Array files as fields: .npy (Python data source, partitioned by time), and NetCDF or MATLAB/HDF5 where their libraries exist."""

from __future__ import annotations

import glob
import importlib.util

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELD = "t long, x long, v int, val double"
#: Bytes of one read.
CHUNK_BYTES = 64 << 20


class _Range(InputPartition):
    def __init__(self, path: str, lo: int, hi: int, offset: int):
        self.path, self.lo, self.hi, self.offset = path, lo, hi, offset


def _batch(block: np.ndarray, t0: int):
    """One Arrow batch of a block [time, cell, variable]."""
    t, x, v = np.indices(block.shape).reshape(3, -1)
    return pa.RecordBatch.from_arrays([pa.array(t + t0), pa.array(x), pa.array(v.astype(np.int32)), pa.array(np.ascontiguousarray(block, float).ravel())], ["t", "x", "v", "val"])


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(glob.glob(options["path"])) or [options["path"]]
        self.nv = int(options.get("n_variables", 1))

    def partitions(self):
        out, offset = [], 0
        for p in self.paths:
            a = np.load(p, mmap_mode="r")
            step = max(1, CHUNK_BYTES // max(1, a[0].nbytes))
            out += [_Range(p, lo, min(lo + step, len(a)), offset) for lo in range(0, len(a), step)]
            offset += len(a)
        return out

    def read(self, partition):
        a = np.load(partition.path, mmap_mode="r")[partition.lo : partition.hi]
        yield _batch(np.asarray(a).reshape(len(a), -1, self.nv), partition.offset + partition.lo)


class NpySource(DataSource):
    """spark.read.format("npy").option("n_variables", 1).load(path or pattern); files follow each other in time."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return FIELD

    def reader(self, schema):
        return NpyReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)


def save_npy(field: DataFrame, path: str, shape: tuple[int, ...], dtype: str = "f8") -> None:
    """Exports a dense field [time, x1.., var]; rows stream through the driver into a mapped file, never all at once."""
    out = np.lib.format.open_memmap(path, "w+", dtype, shape)
    flat = out.reshape(shape[0], -1, shape[-1])
    for r in field.toLocalIterator(prefetchPartitions=True):
        flat[r.t, r.x, r.v] = r.val
    out.flush()


def _need(module: str, kind: str) -> None:
    if importlib.util.find_spec(module) is None:
        raise ImportError(f"reading {kind} files needs the package {module}, which is not installed")


def read_netcdf(spark: SparkSession, paths: list[str], variables: list[str]) -> DataFrame:
    """Variables [time, x1..] of NetCDF files, time chunks in parallel."""
    _need("netCDF4", "NetCDF")
    import netCDF4

    parts, offset = [], 0
    for p in sorted(paths):
        with netCDF4.Dataset(p) as d:
            shape = d[variables[0]].shape
        step = max(1, CHUNK_BYTES // max(1, 8 * int(np.prod(shape[1:]))))
        parts += [(p, lo, min(lo + step, shape[0]), offset) for lo in range(0, shape[0], step)]
        offset += shape[0]

    def run(batches):
        import netCDF4

        for b in batches:
            for p, lo, hi, off in zip(*(c.to_pylist() for c in b.columns)):
                with netCDF4.Dataset(p) as d:
                    block = np.stack([np.ma.filled(d[v][lo:hi].astype(float), np.nan).reshape(hi - lo, -1) for v in variables], -1)
                yield _batch(block, off + lo)

    return spark.createDataFrame(parts, "path string, lo long, hi long, off long").repartition(len(parts), "path", "lo").mapInArrow(run, FIELD)


def read_matlab(spark: SparkSession, paths: list[str]) -> DataFrame:
    """HDF5-based MATLAB files, one snapshot [variable, x1..] each, in order of name."""
    _need("h5py", "MATLAB/HDF5")
    parts = list(enumerate(sorted(paths)))

    def run(batches):
        import h5py

        for b in batches:
            for t, p in zip(b["t"].to_pylist(), b["path"].to_pylist()):
                with h5py.File(p) as d:
                    a = np.asarray(d[next(iter(d))], float)
                if not np.isfinite(a).all():
                    raise ValueError(f"{p} holds non-finite values")
                yield _batch(np.moveaxis(a, 0, -1).reshape(1, -1, a.shape[0]), t)

    return spark.createDataFrame(parts, "t long, path string").repartition(len(parts), "t").mapInArrow(run, FIELD)


def read_data(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A field by file kind."""
    kind = (format or path.rpartition(".")[2]).lower().lstrip(".")
    if kind == "npy":
        register(spark)
        return spark.read.format("npy").options(**options).load(path)
    if kind == "nc":
        return read_netcdf(spark, sorted(glob.glob(path)), options["variables"])
    if kind == "mat":
        return read_matlab(spark, sorted(glob.glob(path)))
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format {kind!r}")

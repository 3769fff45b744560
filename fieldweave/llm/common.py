"""Shared helpers of the training-data operators: scratch tables, hashing, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of other characters.
SPACES = " \t\n\x0b\x0c\r"



def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset, one of our own: a temporary folder if all tasks run in this
    process, as in tests, else one in the warehouse, which a cluster shares."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        alone = re.match(r"local(\[|$)", spark.sparkContext.master)
        where = "file://" + tempfile.mkdtemp(prefix="fieldweave-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Runs df once and returns the written rows; `.scratch_path` names the folder for drop()."""
        path = self.path(label)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        """Removes tables that no later plan reads."""
        for t in tables:
            delete(self.spark, t if isinstance(t, str) else t.scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spaced(text):
    """A text column with each ASCII white space as a space (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def split_words(text):
    """Words of a text column as an array (null: none), inside the JVM; splitting at a plain space needs no pattern."""
    return F.array_remove(F.split(spaced(text), " ", -1), "")


words_col = split_words


def mix64(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slices(batch: pa.RecordBatch, rows: int = 512):
    """Smaller pieces of an Arrow batch, so that Python lists of whole texts stay small."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def prefer(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; other columns, whatever they are called, stay out of the operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out

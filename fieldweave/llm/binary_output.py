"""Token-id shards: a concatenated id array with Elias-Fano document boundaries.

`write_shards` encodes whole texts and writes one binary file per range of doc_id; `read_shards` reads the
files back as one row per document. A shard is

    ids (2 or 4 bytes each) | Elias-Fano boundaries | Elias-Fano doc ids | footer

and is written as a stream: of what is written, only lengths and doc ids (16 bytes a document) are held in memory. Reading goes
through select and holds RUN boundaries and doc ids at a time.

Cases: null or empty text gives the end id alone; documents come in ascending doc_id order, null ids first,
rows that repeat a doc_id in the order of their texts' hashes; an empty table gives no shards and no rows;
extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prefer, shuffle_partitions, slices
from .tokens import encoder

_FOOTER = struct.Struct("<8sQQQQQqQ")
_MAGIC = b"FWIDS001"
#: Ones between two samples of the select structure.
SAMPLE = 256
#: Values that are packed or read at once.
RUN = 4096


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(u/n) bits a value, with select by sampled ones."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = [np.zeros(0, np.uint8)]
        for i in range(0, n if low_bits else 0, RUN):  # RUN values fill whole bytes
            bits = (v[i : i + RUN, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        low = np.concatenate(low)
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1, np.uint8)
        high[at] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def _low(self, lo: int, hi: int) -> list[int]:
        if not self.low_bits:
            return [0] * (hi - lo)
        first, last = lo * self.low_bits, hi * self.low_bits
        bits = np.unpackbits(self.low[first >> 3 : (last + 7) >> 3], bitorder="little")[first & 7 :][: last - first]
        return (bits.reshape(hi - lo, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1).tolist()

    def _place(self, i: int) -> int:
        """Where the i-th one of the high bits is, searched from the sample before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        left += int(np.bitwise_count(self.high[byte] & np.uint8((1 << (at & 7)) - 1)))
        while True:
            part = self.high[byte : byte + 64]
            counts = np.cumsum(np.bitwise_count(part))
            if counts[-1] > left:
                k = int(np.searchsorted(counts, left, side="right"))
                left -= int(counts[k - 1]) if k else 0
                return (byte + k) * 8 + int(np.flatnonzero(np.unpackbits(part[k : k + 1], bitorder="little"))[left])
            left -= int(counts[-1])
            byte += 64

    def select(self, i: int) -> int:
        """Value i."""
        return ((self._place(i) - i) << self.low_bits) | self._low(i, i + 1)[0]

    def window(self, lo: int, hi: int) -> np.ndarray:
        """Values lo .. hi - 1: both ends are selected, and the high bits between them are read."""
        if hi <= lo:
            return np.zeros(0, np.int64)
        a, b = self._place(lo), self._place(hi - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[a >> 3 : (b >> 3) + 1], bitorder="little")) + (a >> 3 << 3)
        ones = ones[np.searchsorted(ones, a) :][: hi - lo]
        return ((ones - np.arange(lo, hi)).astype(np.int64) << self.low_bits) | np.array(self._low(lo, hi), np.int64)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", data)
        raw = np.frombuffer(data, np.uint8, offset=25)
        return cls(n, low_bits, raw[:a], raw[a : a + b], raw[a + b :].view("<u4") if n else np.zeros(0, np.uint32))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class ShardWriter:
    """Streams documents into one shard."""

    def __init__(self, folder: str, width: int):
        self.uri = f"{folder}/{uuid.uuid4().hex}.ids"
        fs, path = _filesystem(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.width, self.ends, self.docs, self.nulls = fs.open_output_stream(path), width, array("q", [0]), array("q"), 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(np.ascontiguousarray(ids.astype("<u2" if self.width == 2 else "<u4")).tobytes())
        self.ends.append(self.ends[-1] + len(ids))
        if doc_id is None:
            self.nulls += 1
        else:
            self.docs.append(doc_id)

    def close(self) -> tuple[str, int, int]:
        base = self.docs[0] if self.docs else 0
        bounds = EliasFano.encode(np.frombuffer(self.ends, np.int64)).to_bytes()
        names = EliasFano.encode(np.frombuffer(self.docs, np.uint64) - np.uint64(base & 0xFFFFFFFFFFFFFFFF)).to_bytes()
        self.out.write(bounds + names)
        self.out.write(_FOOTER.pack(_MAGIC, self.width, self.ends[-1], len(self.ends) - 1, len(bounds), len(names), base, self.nulls))
        self.out.close()
        return self.uri, len(self.ends) - 1, self.ends[-1]


class Shard:
    """Random access to a shard: ids(i) reads one document through select."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.width, self.n_ids, self.n_docs, a, b, base, nulls = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is no id shard")
        self.bounds = EliasFano.from_bytes(self.file.read_at(a, self.n_ids * self.width))
        self.names, self.base, self.nulls = EliasFano.from_bytes(self.file.read_at(b, self.n_ids * self.width + a)), base, nulls

    def docs(self, lo: int, hi: int) -> list[int | None]:
        """Doc ids of documents lo .. hi - 1; null ids come first."""
        k = min(max(self.nulls - lo, 0), hi - lo)
        return [None] * k + [int(x) + self.base for x in self.names.window(lo + k - self.nulls, hi - self.nulls)]

    def span(self, start: int, end: int) -> np.ndarray:
        raw = self.file.read_at((end - start) * self.width, start * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def ids(self, i: int) -> np.ndarray:
        return self.span(self.bounds.select(i), self.bounds.select(i + 1))

    def documents(self, most: int = 1 << 20):
        """(doc_id, start, ids) in order; a long document is read alone, short ones in runs of at most `most` ids."""
        for lo in range(0, self.n_docs, RUN):
            hi = min(lo + RUN, self.n_docs)
            ends, docs, i = self.bounds.window(lo, hi + 1), self.docs(lo, hi), 0
            while i < hi - lo:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
                block = self.span(int(ends[i]), int(ends[j]))
                for k in range(i, j):
                    yield docs[k], int(ends[k]), block[ends[k] - ends[i] : ends[k + 1] - ends[i]]
                i = j


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, vocabulary: int = 50_257) -> DataFrame:
    """Writes shards below folder (a shared store) and returns the manifest, in shard order:
    shard int, path string, n_docs long, n_ids long. A lost task writes its shard anew under another name;
    only files named in the manifest count."""
    spark, width = docs.sparkSession, 2 if vocabulary <= 1 << 16 else 4
    slim = prefer(docs, "doc_id", "text").withColumn("_h", F.xxhash64("text"))
    ordered = slim.repartitionByRange(shuffle_partitions(spark), "doc_id", "_h").sortWithinPartitions("doc_id", "_h")

    def run(batches):
        from pyspark import TaskContext

        out, enc, tail = None, encoder(tokenizer, "byte"), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    out = out or ShardWriter(folder, width)
                    out.add(doc, np.frombuffer(enc.encode(text) + tail, "<u4"))
        if out:
            path, n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = ordered.mapInArrow(run, "shard int, path string, n_docs long, n_ids long").collect()  # one row a shard
    return spark.createDataFrame(sorted(map(tuple, rows)), "shard int, path string, n_docs long, n_ids long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, read from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (unsigned, over ids as little-endian unsigned 32-bit integers)."""
    spark, rows, total, placed = manifest.sparkSession, sorted(map(tuple, manifest.collect())), 0, []
    for shard, path, _, n_ids in rows:
        placed.append((path, total))
        total += n_ids

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches):
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                out = []
                for doc, start, ids in Shard(path).documents():
                    out.append((doc, base + start, len(ids), zlib.crc32(ids)))
                    if len(out) == RUN:
                        yield rows_of(out)
                        out = []
                if out:
                    yield rows_of(out)

    table = spark.createDataFrame(placed, "path string, base long")
    if placed:
        table = table.repartition(min(len(placed), shuffle_partitions(spark)), "path")
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = Scratch(spark, "shards").path("ids")
    return read_shards(write_shards(docs, folder, public_tokenizers.path("byte_bpe_50k.json")))

"""Best-fit packing by a linear grouping scheme.

Piece lengths lie between 1 and the capacity, so their histogram has at most `capacity` entries whatever the
number of documents. The whole plan is made on it: large lengths are rounded up within groups of equal
cardinality, configurations of the few rounded sizes are chosen by bounded knapsack, actual lengths take the
places of the rounded ones, and small lengths go best-fit into what is left. The plan says, for each length,
which ranks go to which sequences and offsets; ranks come from counts by task, so no group of equal lengths
ever meets in one task.

Cases: null text is empty (the end id alone); only documents longer than the capacity are cut; repeated rows
are packed as often as they come; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, prefer, slices
from .tokens import encoder

_PIECES = "pid int, doc_id long, piece int, start long, length int, ids_crc32 long, local long"
_RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass
class Bins:
    """`count` alike sequences; content: (length, pieces of it in each sequence)."""

    count: int
    free: int
    content: list[tuple[int, int]] = field(default_factory=list)


def _groups(hist: np.ndarray, large: int, n_groups: int) -> list[dict[int, int]]:
    """Lengths >= large, descending, in groups of equal cardinality (a length may be shared by two groups)."""
    total = int(hist[large:].sum())
    size, groups, room = max(1, -(-total // n_groups)), [], 0
    for length in range(len(hist) - 1, large - 1, -1):
        left = int(hist[length])
        while left:
            if not room:
                groups.append({})
                room = size
            take = min(left, room)
            groups[-1][length] = groups[-1].get(length, 0) + take
            left, room = left - take, room - take
    return groups


def _best_configuration(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """The fullest multiset of sizes within capacity that holds the largest one left."""
    first = int(np.flatnonzero(counts)[0])
    use = np.zeros(len(sizes), int)
    use[first] = 1
    room = capacity - int(sizes[first])
    reached = np.full(room + 1, -1, int)  # the size by which a sum was first reached
    reached[0] = len(sizes)
    for g in range(first, len(sizes)):
        s, most = int(sizes[g]), int(counts[g]) - (g == first)
        for _ in range(min(most, room // s)):
            new = np.flatnonzero((reached[s:] < 0) & (reached[: room + 1 - s] >= 0))
            if not len(new):
                break
            reached[new + s] = g
    at = int(np.flatnonzero(reached >= 0)[-1])
    while at:
        g = reached[at]
        use[g] += 1
        at -= int(sizes[g])
    return use


def plan(hist: np.ndarray, capacity: int, large: int | None = None, n_groups: int = 400) -> list[Bins]:
    """Sequences for hist[length] pieces of each length."""
    hist = np.asarray(hist, np.int64).copy()
    done = [Bins(int(hist[capacity]), 0, [(capacity, 1)])] if hist[capacity] else []
    hist[capacity] = 0
    large = large or max(2, capacity // 4)
    groups = _groups(hist, large, n_groups)
    sizes = np.array([max(g) for g in groups], int)
    counts = np.array([sum(g.values()) for g in groups], np.int64)
    open_bins: dict[int, list[Bins]] = {}

    def keep(b: Bins) -> None:
        (open_bins.setdefault(b.free, []) if b.free else done).append(b)

    while counts.any():
        use = _best_configuration(sizes, counts, capacity)
        times = int((counts[use > 0] // use[use > 0]).min())
        counts -= use * times
        parts = [Bins(times, capacity)]
        for g in np.repeat(np.arange(len(sizes)), use):  # substitute actual lengths, largest first
            after = []
            for b in parts:
                left = b.count
                while left:
                    length = next(iter(groups[g]))
                    n = min(left, groups[g][length])
                    groups[g][length] -= n
                    if not groups[g][length]:
                        del groups[g][length]
                    after.append(Bins(n, b.free - length, [*b.content, (length, 1)]))
                    left -= n
            parts = after
        for b in parts:
            keep(b)
    for length in range(min(large, capacity) - 1, 0, -1):  # small ones, best fit
        left = int(hist[length])
        while left:
            free = min((f for f, v in open_bins.items() if f >= length and v), default=None)
            if free is None:
                each = min(capacity // length, left)
                keep(Bins(left // each, capacity - each * length, [(length, each)]))
                left -= left // each * each
                continue
            b = open_bins[free].pop()
            each = min(free // length, left)
            n = min(b.count, left // each)
            if n < b.count:
                open_bins[free].append(Bins(b.count - n, free, b.content))
            keep(Bins(n, free - each * length, [*b.content, (length, each)]))
            left -= n * each
    return done + [b for v in open_bins.values() for b in v]


def layout(bins: list[Bins], capacity: int) -> dict[str, np.ndarray]:
    """Plan rows sorted by (length, first rank): ranks [rank, rank + n) of a length go, `each` to a sequence,
    from sequence `sequence` on, at `offset` and further."""
    rows, used, sequence = [], [0] * (capacity + 1), 0
    for b in bins:
        at = 0
        for length, each in b.content:
            rows.append((length, used[length], b.count * each, sequence, each, at))
            used[length] += b.count * each
            at += length * each
        sequence += b.count
    rows.sort()
    names = ("length", "rank", "n", "sequence", "each", "offset")
    return {k: np.array(v, np.int64) for k, v in zip(names, zip(*rows) if rows else [[]] * 6)}


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of at most `capacity` ids; `local` counts the pieces of one length within one task."""

    def run(batches):
        from pyspark import TaskContext

        pid, enc, tail = TaskContext.get().partitionId(), encoder(tokenizer, "word"), np.array([end_id], "<u4").tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in range(7)]
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    ids = memoryview(enc.encode(text) + tail)
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        n = len(piece) // 4
                        for column, value in zip(out, (pid, doc, k, at // 4, n, zlib.crc32(piece), seen[n])):
                            column.append(value)
                        seen[n] += 1
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [x.split()[0] for x in _PIECES.split(", ")])

    return prefer(docs, "doc_id", "text").mapInArrow(run, _PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(cut(docs, tokenizer, capacity, end_id), "pieces")
    counts = pieces.groupBy("length", "pid").count()
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("count")).collect():  # at most `capacity` rows
        hist[length] = n
    table = layout(plan(hist, capacity), capacity)
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("length", "pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(ranks, ["length", "pid"]).withColumn("rank", F.col("local") + F.col("before"))
    key = table["length"] * (1 << 45) + table["rank"]

    def run(batches):
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 45) + rank, side="right") - 1
            k = rank - table["rank"][at]
            sequence = table["sequence"][at] + k // table["each"][at]
            offset = table["offset"][at] + k % table["each"][at] * length
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["piece"], batch["start"], pa.array(length), batch["ids_crc32"], pa.array(sequence), pa.array(offset)], [x.split()[0] for x in _RESULT.split(", ")])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

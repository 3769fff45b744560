"""MinHash near-duplicate detection, confirmed on full shingle sets.

1. A scan turns each whole text into its set of distinct word shingles (64-bit hashes) and keeps a 128-bit key
   of the set, 40 band keys of 5 universal-hash minima each, and one byte of each of the 200 minima (the sketch).
2. Sets with one key form one class; only classes go on. Their members never meet. Classes that share a band with another
   one have their full sets written, once.
3. Each class is dealt to one centre: of the most central members of its buckets (those in the fullest buckets), the one
   that it shares most bands with. Centre and members are compared on full sets, in cells of bounded size that count
   common shingles through an inverted index; a cell emits a spanning forest of its links, never its pairs.
   Large-star and small-star make components of them.
4. In all buckets that still span several components, members outside the bucket's largest component are compared with
   everyone by sketch, in cells of bounded size; a cell emits a spanning forest of pairs that might be linked.
   Components that these tie together form a family, and a family's members outside its largest component are compared
   with everyone in it on full sets, again in cells. So every candidate pair of different components is looked at.

A pair at similarity 0.8 shares no band with probability (1 - 0.8^5)^40 < 2e-7, and its sketch falls below the
cut with less than 1e-7; pairs above are safer still.

Cases: null or wordless text has an empty set and is linked with nothing; fewer words than a shingle form one
shingle; null doc_id takes part in no link (component_id null, kept); repeated rows are copies of one document
and share its row values; rows that repeat a doc_id with other texts are documents of their own; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_names, mix64, prefer, slices
from .components import connected_components

BANDS, ROWS = 40, 5
#: Agreeing sketch bytes of BANDS * ROWS that let a pair on to the full sets; 160 are expected at 0.8.
SKETCH_MIN = 128
#: Members of one block of a bucket when sketches are compared, and shingles of one block when full sets are, on average.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
#: Words whose hash a worker remembers.
CACHE_WORDS = 150_000

_rng = np.random.default_rng(20_240_601)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MULTIPLY = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > CACHE_WORDS:
        _HASHES.clear()
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(w) - width + 1
    if n < 1:
        width, n = len(w), 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ w[i : i + n]) * _MULTIPLY[i]
        h ^= h >> np.uint64(29)
    return np.unique(mix64(h))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minima [set, hash] of non-empty sets under a*x + b mod 2^32 on the hashes' upper halves."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out, t = np.empty((len(sets), len(_A)), np.uint32), np.empty_like(x)
    for j, (a, b) in enumerate(zip(_A, _B)):
        np.multiply(x, a, out=t)
        t += b
        out[:, j] = np.minimum.reduceat(t, starts)
    return out


def _signatures(width: int):
    import xxhash

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                sets = [shingles(t, width) for t in part["text"].to_pylist()]
                full = [s for s in sets if len(s)]
                bands, sketch = [None] * len(sets), [None] * len(sets)
                if full:
                    low = minima(full)
                    keys = np.full((len(full), BANDS), 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
                    for r in range(ROWS):
                        keys = (keys ^ low[:, r::ROWS].astype(np.uint64)) * _MULTIPLY[r]
                        keys ^= keys >> np.uint64(31)
                    keys, small = mix64(keys).view(np.int64), low.astype(np.uint8)
                    for k, i in enumerate(i for i, s in enumerate(sets) if len(s)):
                        bands[i], sketch[i] = keys[k], small[k].tobytes()
                kid = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["tkey"], pa.array([len(s) for s in sets], pa.int64()), pa.array(kid, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "tkey", "n_shingles", "kid", "bands", "sketch"],
                )

    return run


def _cells(batches, columns: list[str]):
    """(column arrays) of each cell; its rows, sorted by (c1, c2, c3), may span several Arrow batches."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("c1", "c2", "c3")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            own = tuple(key[:, lo].tolist())
            if own != now and held:
                yield held
                held = []
            now = own
            # A copy, as a slice would keep its whole batch alive.
            held.append([batch[c].slice(lo, hi - lo).to_pylist() for c in columns])
    if held:
        yield held


def _joined(held: list[list[list]]) -> list[list]:
    return [[x for part in held for x in part[c]] for c in range(len(held[0]))]


class _Forest:
    """Links of a cell that join different components: at most one less than it has members."""

    def __init__(self, labels: list):
        _, self.label = np.unique(np.array(labels, dtype=object), return_inverse=True)
        self.edges: list[tuple[int, int]] = []

    def others(self, i: int) -> np.ndarray:
        return self.label != self.label[i]

    def join(self, i: int, linked: np.ndarray) -> None:
        for j in linked:
            if self.label[j] != self.label[i]:
                self.label[self.label == self.label[j]] = self.label[i]
                self.edges.append((i, int(j)))


def _edges(pairs, kid: list) -> pa.RecordBatch:
    u, v = zip(*((min(kid[i], kid[j]), max(kid[i], kid[j])) for i, j in pairs))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])


def _in_sketches(batches):
    """Ties of components within one cell of a bucket: pairs whose sketches agree enough."""
    for held in _cells(batches, ["kid", "comp", "main", "sketch"]):
        kid, comp, main, sketch = _joined(held)
        forest, sk = _Forest(comp), np.frombuffer(b"".join(sketch), np.uint8).reshape(len(kid), -1)
        hub = main.index(True) if True in main else 0
        for i in [hub, *(i for i, m in enumerate(main) if not m)]:
            if i == hub or forest.label[i] != forest.label[hub]:
                at = np.flatnonzero(forest.others(i))
                forest.join(i, at[(sk[at] == sk[i]).sum(1) >= SKETCH_MIN])
        if forest.edges:
            yield _edges(forest.edges, comp)


def _in_sets(percent: int):
    """Links within a cell, on full sets; members of its main component are compared with the others only."""

    def run(batches):
        for held in _cells(batches, ["kid", "comp", "main", "x"]):
            kid, comp, main, sets = _joined(held)
            if len(kid) < 2:
                continue
            n = np.array([len(x) // 8 for x in sets])
            start = np.concatenate([[0], np.cumsum(n)])
            flat = np.frombuffer(b"".join(sets), np.uint64)
            del held, sets
            # Inverted index: the members that hold each shingle, shingle by shingle.
            order = np.argsort(flat, kind="stable")
            owner = np.repeat(np.arange(len(kid), dtype=np.int32), n)[order]
            ordered = flat[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            size = np.diff(np.append(first, len(flat)))
            rank = np.empty(len(flat), np.int64)
            rank[order] = np.repeat(np.arange(len(first)), size)
            del order, ordered, flat
            forest, hub = _Forest(comp), main.index(True) if True in main else 0
            for i in [hub, *(i for i, m in enumerate(main) if not m)]:
                # Who is in the hub's component needs no turn: the others meet it in theirs.
                if i != hub and forest.label[i] == forest.label[hub]:
                    continue
                own = rank[start[i] : start[i + 1]]
                own = own[size[own] > 1]
                width = size[own]
                places = np.repeat(first[own] - (np.cumsum(width) - width), width) + np.arange(width.sum())
                both = np.bincount(owner[places], minlength=len(kid))
                forest.join(i, np.flatnonzero(forest.others(i) & (100 * both >= percent * (n[i] + n - both))))
            if forest.edges:
                yield _edges(forest.edges, kid)

    return run


def _dealt(cells: DataFrame) -> DataFrame:
    """Rows of one cell (c1, c2, c3) next to each other."""
    return cells.repartition("c1", "c2", "c3").sortWithinPartitions("c1", "c2", "c3")


def _label(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tkey, n_shingles, kid of linkable rows; kid, component, component_id of their classes)."""
    spark = docs.sparkSession
    scratch, texts = Scratch(spark, "near"), prefer(docs, "doc_id", "text").withColumn("tkey", F.xxhash64("text"))
    sig = scratch.write(texts.mapInArrow(_signatures(width), "doc_id long, tkey long, n_shingles long, kid binary, bands array<long>, sketch binary"), "signatures")
    linkable = sig.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.write(linkable.groupBy("kid").agg(F.min_by(F.struct("doc_id", "tkey", "n_shingles", "bands", "sketch"), F.struct("doc_id", "tkey")).alias("r")).select("kid", "r.*"), "classes")
    members = classes.select("kid", F.explode("bands").alias("band"))
    full = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.write(members.join(full, "band"), "shared")
    met = shared.groupBy("kid").agg(F.sum("n").alias("reach"))
    asked = classes.join(met, "kid").select("kid", "doc_id", "tkey", "n_shingles", "sketch", "reach")
    asked = scratch.write(asked, "asked")

    def full_sets(batches):
        for batch in batches:
            for part in slices(batch, 256):
                yield pa.RecordBatch.from_arrays([part["kid"], pa.array([shingles(t, width).tobytes() for t in part["text"].to_pylist()], pa.binary())], ["kid", "x"])

    sets = texts.join(asked.select("doc_id", "tkey", "kid"), ["doc_id", "tkey"]).select("kid", "text")
    sets = scratch.write(sets.mapInArrow(full_sets, "kid binary, x binary").dropDuplicates(["kid"]), "sets")

    # First links: every class meets one centre.
    reach = shared.join(asked.select("kid", "reach"), "kid")
    centres = reach.groupBy("band").agg(F.max(F.struct("reach", "kid")).alias("c"))
    ties = reach.join(centres, "band").where(F.col("kid") != F.col("c.kid")).groupBy("kid", F.col("c.kid").alias("u"), F.col("c.reach").alias("r")).count()
    best = scratch.write(ties.groupBy("kid").agg(F.max(F.struct("count", "r", "u")).alias("b")).select("kid", F.col("b.u").alias("u")).join(asked.select("kid", "n_shingles"), "kid"), "best")
    rooms = best.groupBy("u").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("rooms"))
    around = best.join(rooms, "u").select("u", F.pmod(F.xxhash64("kid"), F.col("rooms")).alias("c3"), "kid")
    around = around.union(rooms.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rooms") - 1)).alias("c3"), F.col("u").alias("kid")))
    cells = around.join(sets, "kid").select(F.xxhash64("u").alias("c1"), F.xxhash64("u", F.lit(1)).alias("c2"), "c3", "kid", F.col("kid").alias("comp"), (F.col("kid") == F.col("u")).alias("main"), "x")
    confirmed = _in_sets(percent)
    first = scratch.write(_dealt(cells).mapInArrow(confirmed, "u binary, v binary"), "links")
    comp1 = connected_components(first, scratch)

    # Then buckets of several components: ties by sketch make families of components.
    placed = scratch.write(asked.join(comp1, asked.kid == comp1.node, "left").select("kid", F.coalesce("component", "kid").alias("comp"), "n_shingles", "sketch"), "placed")
    inside = shared.select("kid", "band").join(placed.select("kid", "comp"), "kid")
    sizes = inside.groupBy("band", "comp").count().groupBy("band").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("count", "comp")).alias("base"), F.max("count").alias("n_base"), F.sum("count").alias("n"))
    open_ = sizes.where("comps > 1").select("band", "base", F.ceil(F.col("n_base") / BLOCK).alias("nm"), F.ceil((F.col("n") - F.col("n_base")) / BLOCK).alias("nr"))
    rest = inside.join(open_, "band").withColumn("main", F.col("comp") == F.col("base")).join(placed.select("kid", "sketch"), "kid")
    tied = scratch.write(_dealt(_grid(rest, F.col("band"), F.lit(0).cast("long")).select("c1", "c2", "c3", "kid", "comp", "main", "sketch")).mapInArrow(_in_sketches, "u binary, v binary").distinct(), "ties")
    family = connected_components(tied, scratch)

    # Families on full sets.
    kin = placed.join(family, placed.comp == family.node).select("kid", "comp", F.col("component").alias("family"), "n_shingles")
    sizes = kin.groupBy("family", "comp").agg(F.sum("n_shingles").alias("s")).groupBy("family").agg(F.max_by("comp", F.struct("s", "comp")).alias("base"), F.max("s").alias("s_base"), F.sum("s").alias("s"))
    sizes = sizes.select("family", "base", F.ceil(F.col("s_base") / BLOCK_SHINGLES).alias("nm"), F.ceil((F.col("s") - F.col("s_base")) / BLOCK_SHINGLES).alias("nr"))
    grid = _grid(kin.join(sizes, "family").withColumn("main", F.col("comp") == F.col("base")), F.xxhash64("family"), F.xxhash64("family", F.lit(1)))
    second = scratch.write(_dealt(grid.join(sets, "kid").select("c1", "c2", "c3", "kid", "comp", "main", "x")).mapInArrow(confirmed, "u binary, v binary"), "links")
    comp = connected_components(first.union(second), scratch)

    named = classes.select("kid", "doc_id").join(comp, classes.kid == comp.node, "left").select("kid", F.coalesce("component", "kid").alias("component"), "doc_id")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = scratch.write(named.join(smallest, "component").select("kid", "component", "component_id"), "result")
    scratch.drop(sets, shared, asked, best, first, placed, tied, second, classes)
    return sig.drop("bands", "sketch"), by_class


def _grid(rows: DataFrame, c1, c2) -> DataFrame:
    """Deals rows to cells (c1, c2, c3): blocks of the rest (nr of them) meet one another and those of the main part (nm)."""
    place, nr, nm = F.xxhash64("kid", F.lit(3)), F.col("nr"), F.col("nm")
    rows = rows.withColumn("blk", F.when(F.col("main"), nr + F.pmod(place, nm)).otherwise(F.pmod(place, nr)))
    meets = F.when(F.col("main"), F.sequence(F.lit(0).cast("long"), nr - 1)).otherwise(F.sequence(F.lit(0).cast("long"), nr + nm - 1))
    rows = rows.withColumn("o", F.explode(meets))
    return rows.withColumns({"c1": c1, "c2": c2, "c3": F.least("blk", "o") * (nr + nm) + F.greatest("blk", "o")})


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (is that document), one row per row of docs."""
    sig, by_class = _label(docs, width, percent)
    own = sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = sig.where("n_shingles > 0 and doc_id is not null").join(by_class, "kid").select("doc_id", "n_shingles", "component_id").union(own)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which one of each group stays: the one with the smallest doc_id (of several texts with that id, the one with the
    smallest key). Rows that repeat doc_id and text stay once; rows without words or without an id all stay."""
    sig, by_class = _label(docs, width, percent)
    linked = sig.where("n_shingles > 0 and doc_id is not null").join(by_class, "kid")
    keep = linked.groupBy("component").agg(F.min(F.struct("doc_id", "kid", "tkey")).alias("k")).select("k.doc_id", "k.tkey")
    own, key = free_names(docs, "row_doc", "row_key")
    keyed = docs.withColumns({own: F.col("doc_id"), key: F.xxhash64("text")})
    linkable = F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    one = keyed.where(linkable).join(keep.select(F.col("doc_id").alias(own), F.col("tkey").alias(key)), [own, key], "left_semi").dropDuplicates([own, key])
    return one.unionByName(keyed.where(~F.coalesce(linkable, F.lit(False)))).drop(own, key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80)

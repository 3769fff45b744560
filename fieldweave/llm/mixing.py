"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all words; no target
exceeds twice its source's words, the excess is shared anew by weight. Schedule: slot i falls at the golden-ratio
point frac(i * phi), which the cumulative targets map to a source; slots are ranked per source, and slot r of a
source takes block r of its documents, shuffled by hash and laid end to end, repeated once over. Blocks hold equally
many words (the last one before a source's end fewer), and there are as many slots as whole blocks in all targets together. So the
points alone decide how often a source comes and in which order; a source's words miss its target by a few blocks at most.

A block holds BLOCK_WORDS words, or the LEAST_SLOTS-th part of the mix where that is less.

Positions and ranks come from sums over buckets of a source, never from one source's rows in one task.

Cases: null source is a source of its own, in last place; null or empty text has size 0, counts for no words and takes none;
repeated rows are documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, free_names, prefer, shuffle_partitions, split_words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Words in a block, at most, and slots in the schedule, at least (as far as there are words).
BLOCK_WORDS, LEAST_SLOTS = 2048, 1 << 16
#: Documents in a bucket of a source, on average.
BUCKET_ROWS = 4096
#: Slots ranked together, and cells of the unit interval in which sources are looked up.
CHUNK, CELLS = 1 << 16, 1 << 12
GOLDEN = 0.6180339887498949
SEED = 20_240_601


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, weight and the cumulative shares lo, hi of each source; sizes: source, size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", MOST_EPOCHS * F.col("source_size").cast("double"))
    everything = Window.partitionBy(F.lit(0))
    ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    per = per.withColumn("ratio", F.col("cap") / F.col("weight"))
    # The level at which sources from here on, in order of cap / weight, share what those before leave them.
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    # The first source that its level does not fill sets it for all after it; those before are full.
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)["level"]
    per = per.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * final, F.col("cap"))))
    total = F.sum("target").over(everything)
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.when(total > 0, upto / total).otherwise(0.0)
    lo = F.when(total > 0, (upto - F.col("target")) / total).otherwise(0.0)
    return per.select("source", "source_size", "target", lo.alias("lo"), hi.alias("hi"))


def laid_out(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Documents with their first word's place `at` in the shuffled source; and the number of rows."""
    slim = prefer(docs, "doc_id", "source", "text").select("doc_id", "source", F.size(split_words(F.col("text"))).cast("long").alias("size"), F.xxhash64("doc_id", F.xxhash64("text"), F.lit(SEED)).alias("h"))
    slim = scratch.write(slim, "sizes")
    n = slim.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    slim = slim.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 32) * buckets) / (1 << 32)).cast("long"))
    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("h", 32), "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    placed = placed.join(sums, placed.source.eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
    return placed.select("doc_id", "source", "size", "h", (F.col("ahead") + F.col("own")).alias("at")), n


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """Slots: source, rank, words (the block's, before a source's end fewer), slot (its place in the schedule)."""
    spark = targets.sparkSession
    wanted = targets.where("target > 0").select("source", "lo", "hi", (MOST_EPOCHS * F.col("source_size")).alias("most"))
    n = int(targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0] // block)
    cells = wanted.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))))
    high = 1 << 20  # i * phi in two parts keeps the fraction exact for large i
    step = (high * GOLDEN) % 1.0
    point = F.pmod(F.expr(f"id div {high}") * F.lit(step) + (F.col("id") % high) * F.lit(GOLDEN), F.lit(1.0))
    slots = spark.range(n).withColumn("p", point).withColumn("cell", F.floor(F.col("p") * CELLS).cast("int"))
    slots = slots.join(cells, "cell").where("p >= lo and p < hi").select("source", "id", "most", F.expr(f"id div {CHUNK}").alias("chunk"))
    # Ranks by source: counts of whole chunks before, then within the chunk.
    per = slots.groupBy("source", "chunk").agg(F.count("*").alias("c"))
    ahead = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("source").alias("s_source"), F.col("chunk").alias("s_chunk"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"), "c")
    within = Window.partitionBy("source", "chunk").orderBy("id")
    ranked = slots.withColumn("r", F.row_number().over(within) - 1)
    ranked = ranked.join(per, ranked.source.eqNullSafe(F.col("s_source")) & (F.col("chunk") == F.col("s_chunk"))).select("source", (F.col("ahead") + F.col("r")).alias("rank"), "most", F.col("id").alias("slot"))
    return ranked.where(F.col("rank") * block < F.col("most")).select("source", "rank", "slot", F.least(F.lit(block), F.col("most") - F.col("rank") * block).alias("words"))


def mix(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, h, size, source_size, target, taken_1, taken_2 (words taken in the first and second
    run through the source), slot_1, slot_2 (the slots of their first words), taken (words in all)."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    placed, _ = laid_out(docs, scratch)
    placed = scratch.write(placed.withColumn("row", F.monotonically_increasing_id()), "placed")
    targets = scratch.write(source_targets(placed.select("source", "size")), "targets")
    total, n_sources = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    block = max(1, min(BLOCK_WORDS, int(total // LEAST_SLOTS)))
    slots = scratch.write(schedule(targets, block), "slots")
    had = slots.groupBy("source").agg(F.sum("words").alias("had")).select(F.col("source").alias("h_source"), "had")
    sizes = targets.join(had, targets.source.eqNullSafe(F.col("h_source")), "left").select(F.col("source").alias("t_source"), "source_size", "target", F.coalesce("had", F.lit(0)).alias("had"))
    known = placed.join(F.broadcast(sizes) if n_sources <= 100_000 else sizes, placed.source.eqNullSafe(F.col("t_source")))
    # Words [lo, hi) of a document's run e lie in blocks lo div block .. (hi - 1) div block of the stream.
    run = F.explode(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1)))
    parts = known.where("size > 0").withColumn("e", run).select("row", "source", "e", (F.col("at") + F.col("e") * F.col("source_size")).alias("lo"), "size", "had").where("lo < had")
    parts = parts.withColumn("hi", F.col("lo") + F.col("size")).withColumn("block", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    met = parts.join(slots.select(F.col("source").alias("k_source"), "rank", "slot", "words"), parts.source.eqNullSafe(F.col("k_source")) & (F.col("block") == F.col("rank")))
    words = F.greatest(F.lit(0), F.least("hi", F.col("block") * block + F.col("words")) - F.greatest("lo", F.col("block") * block))
    each = [F.when(F.col("e") == e, F.col("t")) for e in range(MOST_EPOCHS)], [F.when((F.col("e") == e) & (F.col("t") > 0), F.struct("block", "slot")) for e in range(MOST_EPOCHS)]
    taken = met.withColumn("t", words).groupBy("row").agg(*[F.sum(c).alias(f"taken_{e + 1}") for e, c in enumerate(each[0])], *[F.min(c)["slot"].alias(f"slot_{e + 1}") for e, c in enumerate(each[1])])
    runs = [F.coalesce(f"taken_{e + 1}", F.lit(0)).alias(f"taken_{e + 1}") for e in range(MOST_EPOCHS)]
    out = known.join(taken, "row", "left").select("doc_id", "source", "h", "size", "source_size", "target", *runs, *[f"slot_{e + 1}" for e in range(MOST_EPOCHS)])
    return out.withColumn("taken", sum((F.col(f"taken_{e + 1}") for e in range(MOST_EPOCHS)), F.lit(0)))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, in the order of its slots: each document as often as it is taken; the one that a source's last block cuts is cut to
    its first words. The column n_chars, if there is one, is set to the characters of the text."""
    doc, source, hashed, words, size, slot = names = free_names(docs, "m_doc", "m_source", "m_hash", "m_words", "m_size", "m_slot")
    scratch = Scratch(docs.sparkSession, "mixing")
    runs = F.explode(F.array(*[F.struct(F.col(f"taken_{e + 1}").alias("t"), F.col(f"slot_{e + 1}").alias("s")) for e in range(MOST_EPOCHS)])).alias("run")
    taken = mix(docs, scratch).where("taken > 0").select("doc_id", "source", "h", "size", runs).where("run.t > 0")
    taken = scratch.write(taken.select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("h").alias(hashed), F.col("run.t").alias(words), F.col("size").alias(size), F.col("run.s").alias(slot)), "taken")
    last = taken.agg(F.max(slot)).first()[0] or 0
    own = free_names(docs.withColumns({n: F.lit(0) for n in names}), "m_own")[0]
    keyed = docs.withColumn(own, F.xxhash64("doc_id", F.xxhash64("text"), F.lit(SEED))).dropDuplicates(["doc_id", "source", own])
    rows = keyed.join(taken, keyed.doc_id.eqNullSafe(F.col(doc)) & keyed.source.eqNullSafe(F.col(source)) & (F.col(own) == F.col(hashed)))
    cut = F.array_join(F.slice(split_words(F.col("text")), F.lit(1), F.col(words).cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col(words) < F.col(size), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    # Slots are dealt to tasks in equal runs.
    tasks = shuffle_partitions(docs.sparkSession)
    ordered = rows.repartitionById(tasks, F.floor(F.col(slot) * tasks / (last + 1)).cast("int")).sortWithinPartitions(slot, own)
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")

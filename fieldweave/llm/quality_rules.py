"""Quality rules with a hashed n-gram log-likelihood ratio, in DataFrame operations only.

The n-grams are single tokens and pairs of neighbouring ones, hashed into a fixed number of buckets. Tokens are whole words, of which
runs of ASCII punctuation are split off as tokens of their own. The raw multinomial counts every document, the target
multinomial the trusted ones. A document's verdict compares its mean log ratio with a fixed threshold.

Trusted ids are broadcast where they are at most TRUSTED_IDS; else texts are shuffled once to meet them by doc_id, with the same
result. Counts reach the shuffle pre-aggregated by bucket; the table of ratios has BUCKETS entries whatever the input.
Scoring explodes each text's n-grams; their ratios are summed by row before a shuffle of one small row a document.

Cases: null text has no words, fails the base rules and is not kept; a text without n-grams scores 0; repeated
rows count and are judged as often as they come; without labels the ratio is 0 everywhere; an empty table gives no
rows; extra columns stay out of the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_names, prefer, spaced

BUCKETS = 1 << 18
#: Trusted ids that are broadcast at most (8 bytes each and a hash table's room).
TRUSTED_IDS = 1_000_000
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.15
#: Pseudo-counts of a bucket, in target counts.
SMOOTH = 10.0
LEAST_WORDS = 50


def _shifted(a, by: int, n: int):
    """Elements by, by + 1, ... of array a (from 0), as many as windows of n fit."""
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - (n - 1), F.lit(0)))


def _with_spaces(df: DataFrame) -> DataFrame:
    """Adds `sp`, the text with plain spaces."""
    return df.withColumn("sp", spaced(F.col("text")))


def _with_grams(df: DataFrame) -> DataFrame:
    """g: hashes of all n-grams of the tokens of `sp`, single ones first, then pairs.

    Lambdas see only their own arguments: an outer column inside one would be computed anew for every element."""
    tokens = F.array_remove(F.split(F.regexp_replace("sp", r"[!-/:-@\[-`{-~]+", " $0 "), " ", -1), "")
    df = df.withColumn("e", F.transform(tokens, lambda x: F.xxhash64(x)))
    pairs = F.zip_with(_shifted(F.col("e"), 0, 2), _shifted(F.col("e"), 1, 2), lambda a, b: F.xxhash64(a, b))
    return df.withColumn("g", F.concat(F.col("e"), pairs))


#: The bucket of an n-gram's hash; outside the lambdas, where it is compiled code.
def _bucket(g):
    return F.pmod(g, F.lit(BUCKETS)).cast("int")


def ratio_table(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """b, r: the log ratio of smoothed target and raw probabilities of each of the BUCKETS buckets."""
    spark = docs.sparkSession
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    trusted = scratch.write(trusted.withColumn("t", F.lit(1)), "trusted")
    trusted = trusted.hint("broadcast" if trusted.count() <= TRUSTED_IDS else "shuffle_hash")
    marked = prefer(docs, "doc_id", "text").join(trusted, "doc_id", "left")
    # explode_outer: for explode, a filter on g would be inferred and computed in front of the shuffle as well. Bucket null is left out below.
    grams = _with_grams(_with_spaces(marked)).select("t", F.explode_outer("g").alias("h")).select("t", _bucket(F.col("h")).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("t").alias("target"))
    dense = scratch.write(spark.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")), "counts")
    n_raw, n_target = dense.agg(F.sum("raw"), F.sum("target")).first()
    if not n_target:
        return dense.select("b", F.lit(0.0).alias("r"))
    # Both are smoothed by as many target counts a bucket, so n-grams too rare to tell weigh nothing.
    ratio = F.log((F.col("target") + SMOOTH) / (F.col("raw") * F.lit(n_target / n_raw) + SMOOTH))
    return dense.select("b", ratio.alias("r"))


def _base(df: DataFrame) -> DataFrame:
    """The base rules' counts, from `text` and `sp`."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"h": F.transform(F.array_remove(F.split("sp", " ", -1), ""), lambda x: F.xxhash64(x)), "lines": lines})
    df = df.withColumns({"n_words": F.size("h").cast("long"), "word_chars": F.length(F.replace("sp", F.lit(" "), F.lit(""))).cast("long")})
    df = df.withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    h = F.col("h")
    pairs = F.zip_with(_shifted(h, 0, 3), _shifted(h, 1, 3), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("x", F.zip_with(pairs, _shifted(h, 2, 3), lambda p, c: F.xxhash64(p, c)))
    df = df.withColumn("repeats", F.size(F.array_distinct("x")) < F.size("x"))
    # Equal windows are neighbours once sorted; the positions that they cover are counted once each.
    df = df.withColumn("s", F.when(F.col("repeats"), F.sort_array(F.transform("x", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))))
    s = F.col("s")
    equal = F.filter(F.zip_with(_shifted(s, 0, 2), _shifted(s, 1, 2), lambda p, q: F.when(p["v"] == q["v"], F.array(p["i"], q["i"]))), lambda y: y.isNotNull())
    starts = F.array_distinct(F.flatten(equal))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    return df.withColumn("n_repeat_words", F.when(F.col("repeats"), F.size(covered)).otherwise(0).cast("long"))


def _judged(docs: DataFrame, ratios: DataFrame) -> DataFrame:
    """key (of doc_id and text), doc_id, the base counts, llr, base_failed and kept, one row per row of docs (doc_id, text).

    The ratios of a text's n-grams come by a hash join with the fixed-size table; they are summed before the shuffle."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = _base(_with_grams(_with_spaces(docs))).withColumn("key", F.xxhash64("doc_id", "text")).withColumn("rid", F.monotonically_increasing_id())
    grams = df.select("rid", "key", "doc_id", *counts, F.explode_outer("g").alias("h")).withColumn("b", _bucket(F.col("h")))
    summed = grams.join(F.broadcast(ratios), "b", "left").groupBy("rid", "key", "doc_id", *counts).agg(F.sum("r").alias("r"), F.count("b").alias("n"))
    out = summed.withColumn("llr", F.coalesce(F.col("r"), F.lit(0.0)) / F.greatest("n", F.lit(1)))
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.round("llr", 9) >= THRESHOLD)).select("key", "doc_id", *counts, "base_failed", "kept", "llr")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr, one row per row of docs."""
    ratios = ratio_table(docs, labels, Scratch(docs.sparkSession, "quality"))
    return _judged(prefer(docs, "doc_id", "text"), ratios).drop("key")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    ratios = ratio_table(docs, labels, Scratch(docs.sparkSession, "quality"))
    key, doc = free_names(docs, "row_key", "row_doc")
    kept = _judged(prefer(docs, "doc_id", "text"), ratios).where("kept").select(F.col("key").alias(key), F.coalesce("doc_id", F.lit(0)).alias(doc)).distinct()
    keyed = docs.withColumns({key: F.xxhash64("doc_id", "text"), doc: F.coalesce("doc_id", F.lit(0))})
    return keyed.join(kept, [key, doc], "left_semi").drop(key, doc)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

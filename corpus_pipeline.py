"""A training-corpus pipeline: five operators over the documents table, one after another.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents.

Cases, in every stage: null doc_id, lang, source and n_chars are allowed; a null text counts as empty; rows that repeat are
rows of their own except where near-duplicates go; an empty table gives no rows; further columns stay as they are, whatever
they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldweave.llm import mixing, near_dedup, packing, quality_rules, toxicity
from fieldweave.llm.common import Scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject. Null and empty texts stay; repeated rows share one verdict; without
    labels only the general lexicon and the patterns judge."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null, empty and short texts (under 50 words) go; repeated rows share one verdict; without
    labels only the base rules judge; a ratio at the threshold passes."""
    return quality_rules.keep_good(docs, _labels(spark, sf_dir))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more. The smallest doc_id stays; rows
    that repeat doc_id and text stay once; rows without words or without a doc_id all stay."""
    return near_dedup.keep_one(docs, width=5, percent=80).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources in the order of its schedule: documents as often as they are taken. Null sources are one source, in last place; texts
    without words are never taken; ties in the shuffle go by doc_id."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents packed into sequences of 2048 tokens. An empty text is one end id; repeated rows are packed as often
    as they come."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("near_dedup", dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        if hasattr(before, "scratch_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

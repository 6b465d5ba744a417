"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
documents; a stage that changes a text also sets n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import scratch
from quern.llm import mixing, neardup, packing, quality, substrings
from quern.llm.queries import VOCABULARY

#: Bytes of rows that a Python worker is given at once: the stages share their executors' memory with all that ran before.
BATCH_BYTES = 2 << 20
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier gives a score of 0.5 or more."""
    scratch.prepare(spark, BATCH_BYTES)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_score(docs.select(*COLUMNS), model).where(F.col(quality.SCORE) >= 0.5).drop(quality.SCORE)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates."""
    scratch.prepare(spark, BATCH_BYTES)
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; others are left as they are."""
    scratch.prepare(spark, BATCH_BYTES)
    cut = substrings.remove_repeats(docs.select(*COLUMNS), carry=("lang", "source"))
    return cut.select("doc_id", F.col("new_text").alias("text"), "lang", "source", F.coalesce(F.char_length("new_text"), F.lit(0)).cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources tempered; no source is read over 1.25 times as often as another, none less than once."""
    scratch.prepare(spark, BATCH_BYTES)
    return mixing.mix_sources(docs.select(*COLUMNS), max_repetition=1.25).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    scratch.prepare(spark, BATCH_BYTES)
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("quality classifier", good_quality),
    ("minhash near-dedup", one_of_near_duplicates),
    ("substring dedup", without_repeats),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

#: The stages score by compression, sign shingles and encode tokens, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch.prepare(spark, BATCH_BYTES)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(*before)  # the next stage reads this one's table alone
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

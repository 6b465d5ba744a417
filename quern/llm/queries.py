"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import scratch
from quern.llm import audit, bpe, conversations, html_text, imatch, masked_lm, mixing, neardup, packing, quality, sharding, substrings, vptree
from quern.llm.oracles import SQL

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    scratch.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_pages(_read(spark, sf_dir, "pages"))


def op2_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by compressed sizes."""
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of every document: sources tempered until none is read over 1.25 times as often as another."""
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents"), max_repetition=1.25)
    return mixed.select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_block_at").alias("block_key"), F.col("_at").alias("row_key"))


def op4_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), VOCABULARY)


def op5_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after dropping 13-word windows that an earlier document starts."""
    kept = substrings.remove_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of each embedding whose id is divisible by 20."""
    return vptree.nearest(_read(spark, sf_dir, "embeddings"))


def op7_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 by jump consistent hashing of doc_id, with the shard among 17."""
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), 16)


def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all of them."""
    return masked_lm.score_documents(_read(spark, sf_dir, "documents"))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text."""
    return imatch.fingerprints_beside_next(_read(spark, sf_dir, "documents"))


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components at five words and a similarity of 0.75."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents")).drop("n_links")


def op11_tensor_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after a fixed damage: its faults and the cheapest edits that mend it."""
    return conversations.summaries(conversations.damage(_read(spark, sf_dir, "conversations")))


def op12_forced_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the text that they decode to, as counts and digests."""
    tokens = bpe.decode_documents(bpe.encode_documents(_read(spark, sf_dir, "documents"), VOCABULARY), VOCABULARY)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def op13_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, in all their orders and in every source."""
    return audit.interactions(audit.masks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_line_blocks": op1_line_blocks,
        "op2_compression": op2_compression,
        "op3_temperature": op3_temperature,
        "op4_bin_slack": op4_bin_slack,
        "op5_count_min": op5_count_min,
        "op6_vp_tree": op6_vp_tree,
        "op7_jump_hash": op7_jump_hash,
        "op8_masked_lm": op8_masked_lm,
        "op9_imatch": op9_imatch,
        "op10_superminhash": op10_superminhash,
        "op11_tensor_repair": op11_tensor_repair,
        "op12_forced_cuts": op12_forced_cuts,
        "op13_shapley": op13_shapley,
    }


def oracle_sql() -> dict[str, str]:
    """The others encode tokens, compress, learn or hash, which SQL has not; tests hold them against brute force."""
    return dict(SQL)

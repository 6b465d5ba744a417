"""Readers of the tables that queries run on, with their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that a table must have; more are allowed.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


class SchemaError(ValueError):
    """A table lacks a declared column or has another type for it."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of ``sf_dir``; declared columns are checked, not coerced."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    want = T._parse_datatype_string(SCHEMAS[name]) if name in SCHEMAS else ()
    have = {f.name: f.dataType for f in df.schema}
    for f in want:
        if have.get(f.name) != f.dataType:
            raise SchemaError(f"{name}.{f.name}: wanted {f.dataType.simpleString()}, found {have.get(f.name)}")
    return df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it has no more partitions than there are cores, as with a file of one row group; else as it is.

    For work that costs far more than moving its rows. A large table is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalogue entries: the source's precedence, content hash and a publication date."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        "text",
        "lang",
        "source",
        "n_chars",
        F.expr("try_cast(substr(source, 4) AS int)").alias("precedence"),
        F.sha2("text", 256).alias("sha"),
        F.expr("date_add(DATE'2015-01-01', cast(doc_id % 3650 as int))").alias("published_on"),
    )


#: The same columns in SQL, for the queries' checks.
CORPUS_SQL = """corpus AS (
  SELECT doc_id, text, lang, source, n_chars, try_cast(substr(source, 4) AS int) AS precedence, sha256(text) AS sha,
         DATE '2015-01-01' + (doc_id % 3650)::int AS published_on
  FROM documents)"""

"""Manifests and text files of a corpus on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X

MANIFEST = "version int, source string, entries array<struct<id: string, file: string, sha: string>>"
VERSION = 1


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, id, file, sha) of every entry of JSON manifests, one manifest a line.

    A manifest of another version, or an id that is none, fails the job that reads it; a
    source may be spread over several manifests.
    """
    read = spark.read.schema(MANIFEST).json(path)
    right = F.coalesce(F.col("version") == VERSION, F.lit(False))
    checked = read.where(F.when(right, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("manifest version "), F.coalesce(F.col("version").cast("string"), F.lit("missing"))))))
    entry = checked.select("source", F.explode("entries").alias("e")).select("source", "e.*")
    valid = F.coalesce(X.is_valid_id(F.col("id")), F.lit(False))
    return entry.where(F.when(valid, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not an id: "), F.coalesce("id", F.lit("null"))))))


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text) of the .txt files in a folder, each read whole; the id is the file's name."""
    read = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.txt$", 1)
    return read.select(name.alias("id"), F.col("value").alias("text"))

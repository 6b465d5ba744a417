"""Sets of documents as bitmaps: one filter for every list of a search and for the counts of facets.

A bitmap covers 32768 ids (a bucket), so a value of a listing is as many small binaries as
the buckets it occurs in, and sets meet bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index(values: DataFrame, doc: str = "doc") -> DataFrame:
    """(value, bucket, bits) of ``values``(doc, value); ids are not negative, null ids and values are left out, repeats count once."""
    known = values.where(F.col(doc).isNotNull() & F.col("value").isNotNull())
    return known.groupBy("value", F.bitmap_bucket_number(F.col(doc)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(doc))).alias("bits"))


def any_of(sets: DataFrame, name: str = "value") -> DataFrame:
    """The union of the sets that share a ``name``."""
    return sets.groupBy(F.col(name).alias("value"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def all_of(sets: DataFrame, n: Column | int) -> DataFrame:
    """What ``n`` sets of a value have in common; a bucket that one of them lacks is empty."""
    want = F.lit(n) if isinstance(n, int) else n
    return sets.groupBy("value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == want).drop("_n")


def within(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each set cut to the bitmap ``chosen``(bucket, bits)."""
    cut = sets.select("value", "bucket").join(chosen.select("bucket", "bits"), "bucket").select("value", "bucket", "bits")
    return all_of(sets.select("value", "bucket", "bits").unionByName(cut), 2)


def sizes(sets: DataFrame) -> DataFrame:
    """(value, n) of sets that are not empty."""
    return sets.groupBy("value").agg(F.sum(F.bitmap_count("bits")).cast("long").alias("n")).where("n > 0")


def holds(bits: Column, doc: Column) -> Column:
    """Whether a bitmap of a document's bucket has it."""
    place = F.bitmap_bit_position(doc)
    byte = F.conv(F.hex(F.substr(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def members(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(value, doc) of ``docs``(doc) in each set."""
    placed = docs.where("doc IS NOT NULL").withColumn("bucket", F.bitmap_bucket_number(F.col("doc")))
    return placed.join(sets, "bucket").where(holds(F.col("bits"), F.col("doc"))).select("value", "doc")

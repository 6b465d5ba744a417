"""Jump consistent hashing (Lamping and Veach, 2014): stable keys to shards without a ring table.

The walk of the algorithm is one built-in higher-order function over a 64-bit linear
congruential state, kept as two 32-bit halves because SQL has no wrapping product. Only
DataFrame functions run; nothing is shuffled to find a shard. Slots inside a shard are
numbered in two levels (block, then place in the block), so that no shard, however large,
is ever sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import scratch

LOW = 0xFFFFFFFF
#: The multiplier of the published algorithm, as halves.
MUL_HI, MUL_LO = 0x27BB2EE6, 0x87B0B0FD
#: Rows of a shard that one task numbers, about.
BLOCK_ROWS = 20_000


def _mul32(a: Column, c: int) -> Column:
    """a * c modulo 2**32, for a below 2**32, without overflow."""
    return (a * F.lit(c & 0xFFFF) + F.shiftleft((a * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(LOW))


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """state * multiplier + 1 modulo 2**64."""
    t0, t1 = lo * F.lit(MUL_LO & 0xFFFF), lo * F.lit(MUL_LO >> 16)
    low = t0 + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    high = F.shiftright(t1, 16) + F.shiftright(low, 32) + _mul32(hi, MUL_LO) + _mul32(lo, MUL_HI)
    return high.bitwiseAND(F.lit(LOW)), low.bitwiseAND(F.lit(LOW))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key, 0 to shards - 1; null key: null.

    The state walks until its next jump leaves the range; every step raises the candidate,
    so ``shards`` steps always suffice.
    """
    long = lambda c: c.cast("long")
    start = F.struct(
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(LOW)).alias("lo"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _advance(s["hi"], s["lo"])
        # floor((b + 1) * 2^31 / (top 31 bits + 1)), b = j of the step before
        to = long(F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))))
        return F.when(s["j"] >= shards, s).otherwise(F.struct(s["j"].alias("b"), to.alias("j"), hi.alias("hi"), lo.alias("lo")))

    return F.when(key.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: s["b"].cast("int")))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", mixed: bool = True) -> DataFrame:
    """Give every document a shard, a slot in it and its shard after one more is appended.

    ``mixed`` hashes the key first, so that runs of neighbouring ids spread evenly. Null
    text counts as empty (size 1, CRC 0); a null key stays null and goes where the hash of
    null leads (unmixed: where key 0 goes); repeated keys share a shard and get slots of
    their own; other columns are not carried. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = F.coalesce(F.xxhash64(F.col(key)) if mixed else F.col(key).cast("long"), F.lit(0))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        hashed.alias("_key"),
    )
    placed = scratch.save(
        narrow.select("doc_id", "size", "text_crc32", "_key", jump_hash(F.col("_key"), shards).alias("shard"), jump_hash(F.col("_key"), shards + 1).alias("grown_shard")),
        "shards",
    )
    blocks = max(1, -(-placed.count() // (shards * BLOCK_ROWS)))
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(blocks)).cast("int"))
    sizes = placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_block").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32")
    return (
        placed.withColumn("_at", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "_block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_at")).cast("long").alias("slot"), "grown_shard")
    )

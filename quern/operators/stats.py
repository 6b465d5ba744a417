"""Exact order statistics without gathering a group's values in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern import scratch

#: Cells that a range of values is cut into, and rows of a cell from which on it is cut again.
CELLS, SMALL = 4096, 20_000
#: Times that cells are cut, at most; each leaves the range between two values of one cell.
ROUNDS = 12


def nearest_rank(rows: DataFrame, key: str, value: str, shares: dict[str, float], cells: int = CELLS, small: int = SMALL) -> DataFrame:
    """(key, a column for each share): the value at rank ceil(share * n) of each group; nulls take no part.

    Rows are counted by cells of equal width, and running sums over the cells of a group find
    the cell of each rank. A cell of more than ``small`` rows becomes the range that is cut
    next, from its least to its largest value, so outliers do not keep the rest together;
    of a small one the distinct values are put in order.
    """
    held = scratch.save(rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")), "values")
    ends = held.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("inside"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("share"), F.greatest(F.ceil(F.col("inside") * p), F.lit(1)).alias("left")) for name, p in shares.items())))
    # Of each group and share: the range that holds the value, how many rows lie in it, and its rank among them.
    asked = scratch.save(ends.withColumn("a", each).select(F.col("k").alias("k2"), "a.share", "lo", "hi", "inside", F.col("a.left").cast("long").alias("left")), "ranks")
    within = held["k"].eqNullSafe(F.col("k2")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    group = Window.partitionBy("k2", "share")
    for _ in range(ROUNDS):
        wide = (F.col("hi") > F.col("lo")) & (F.col("inside") > small)
        if asked.where(wide).isEmpty():
            break
        cell = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / cells)), F.lit(cells - 1))
        counts = held.join(asked.where(wide), within).groupBy("k2", "share", "left", cell.alias("cell")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("inside"))
        before = F.coalesce(F.sum("inside").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("before", before).where("before < left AND left <= before + inside")
        rest = asked.where(~wide)
        asked = scratch.save(found.select("k2", "share", "lo", "hi", "inside", (F.col("left") - F.col("before")).alias("left")).unionByName(rest), "ranks")
    known = asked.where("hi = lo").select("k2", "share", F.col("lo").alias("v"))
    inside = held.join(asked.where("hi > lo"), within).groupBy("k2", "share", "left", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    picked = inside.withColumn("upto", upto).where("upto >= left").groupBy("k2", "share").agg(F.min("v").alias("v")).unionByName(known)
    wide_ = picked.groupBy("k2").agg(*(F.max(F.when(F.col("share") == name, F.col("v"))).alias(name) for name in shares))
    return wide_.withColumnRenamed("k2", key)

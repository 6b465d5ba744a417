"""Running sums, maxima and last values in two levels, so that no key is one task.

Rows are dealt over ranges of (key, order) and written with the number of their range. A
window inside a range does most of the work; what a key has in the ranges before comes from
one row for each range and key that may lie in two: the first and the last key of a range.
Those few rows are summed up in order and broadcast back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import scratch

RANGE = "_range"


@dataclass(frozen=True)
class Running:
    """kind: sum, max, min or last (null values count as values); ``before``: without the row itself."""

    kind: str
    value: Column
    before: bool = False


def total(value: Column | str, before: bool = False) -> Running:
    return Running("sum", F.col(value) if isinstance(value, str) else value, before)


def most(value: Column | str, before: bool = False) -> Running:
    return Running("max", F.col(value) if isinstance(value, str) else value, before)


def least(value: Column | str, before: bool = False) -> Running:
    return Running("min", F.col(value) if isinstance(value, str) else value, before)


def previous(value: Column | str) -> Running:
    """The value of the row before; null in the first row of a key."""
    return Running("last", F.col(value) if isinstance(value, str) else value, True)


def ranged(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """``rows`` as a written table with their range; nulls come first. ``ranges``: how many, by default as many as a shuffle has."""
    by = [*keys, *order]
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    return scratch.save(dealt.withColumn(RANGE, F.spark_partition_id()), "ranged")


def over(held: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], **values: Running) -> DataFrame:
    """Columns of running values on rows that :func:`ranged` dealt by the same keys and order; ``_range`` stays."""
    inside = Window.partitionBy(RANGE, *keys).orderBy(*order)
    frame = lambda v: inside.rowsBetween(Window.unboundedPreceding, -1 if v.before else 0)
    # A struct is never null, so a last value may be.
    fold = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(F.struct(c.alias("v")))}
    local = held.withColumns({f"_own_{n}": fold[v.kind](v.value).over(frame(v)) for n, v in values.items()})

    key = F.struct(*keys) if keys else F.lit(True)
    ends = held.groupBy(RANGE).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))  # a row a range
    edges = ends.select(F.col(RANGE).alias("_r"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_key"))
    place = F.struct(*order)
    part = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.max_by(F.struct(c.alias("v")), place)}
    here = held.join(F.broadcast(edges), (F.col(RANGE) == F.col("_r")) & key.eqNullSafe(F.col("_key")))
    sums = here.groupBy("_r", "_key").agg(*(part[v.kind](v.value).alias(f"_part_{n}") for n, v in values.items()))
    ahead = Window.partitionBy("_key").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    up = {"sum": F.sum, "max": F.max, "min": F.min, "last": F.last}
    offsets = sums.select("_r", "_key", *(up[v.kind](f"_part_{n}").over(ahead).alias(f"_off_{n}") for n, v in values.items()))
    joined = local.join(F.broadcast(offsets), (F.col(RANGE) == F.col("_r")) & key.eqNullSafe(F.col("_key")), "left")

    def whole(n: str, v: Running) -> Column:
        own, off = F.col(f"_own_{n}"), F.col(f"_off_{n}")
        if v.kind == "sum":
            return F.coalesce(own + off, own, off)
        return F.greatest(own, off) if v.kind == "max" else F.least(own, off) if v.kind == "min" else F.coalesce(own, off)["v"]

    return joined.select(*held.columns, *(whole(n, v).alias(n) for n, v in values.items()))


def running(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], ranges: int | None = None, **values: Running) -> DataFrame:
    """``rows`` with running values along ``order`` within ``keys`` (all rows as one if there are none).

    Rows that tie in key and order lie in one range, in no particular order.
    """
    return over(ranged(rows, keys, order, ranges), keys, order, **values).drop(RANGE)

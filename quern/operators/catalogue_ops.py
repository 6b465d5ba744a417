"""Merging, diffing and counting of catalogue entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import scan


def canonical(entries: DataFrame, key: str = "doc_id", content: str = "sha", precedence: str = "precedence") -> DataFrame:
    """``entries`` with canonical_id: equal contents of different sources merge into the earliest source.

    Entries of one source never merge with each other, nor do entries without content hash.
    The canonical entry is the smallest id of the first source; it is found by a grouped
    minimum, so many copies of one content meet as one row for each task.
    """
    first = entries.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(F.struct(precedence, key)).alias("_first"))
    joined = entries.join(first, content, "left")
    own = F.col("_first").isNull() | F.col(precedence).isNull() | (F.col(precedence) == F.col(f"_first.{precedence}"))
    return joined.withColumn("canonical_id", F.when(own, F.col(key)).otherwise(F.col(f"_first.{key}"))).drop("_first")


def upsert(current: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` over those of ``current``; columns in ``keep`` stay as they are where the row exists."""
    a, b = current.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    in_new, in_current = F.col(f"b.{key}").isNotNull(), F.col(f"a.{key}").isNotNull()

    def pick(c: str) -> Column:
        taken = in_new & ~in_current if c in keep else in_new
        have = F.col(f"b.{c}") if c in new.columns else F.lit(None)
        return F.when(taken, have).otherwise(F.col(f"a.{c}")).alias(c)

    return joined.select(*(pick(c) for c in current.columns))


def replace_group(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` give way to its rows."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_cascade(stale: DataFrame, key: str, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each table without the rows whose column refers to a stale key."""
    return [t.join(stale.select(F.col(key).alias(c)), c, "left_anti") for t, c in tables]


def changed(new: DataFrame, old: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows of ``new`` that are absent from ``old`` or differ in a column (nulls compare equal)."""
    o = old.select(F.col(key).alias("_k"), F.struct(*columns).alias("_was"))
    differs = F.col("_k").isNull() | ~F.col("_was").eqNullSafe(F.struct(*columns))
    return new.join(o, new[key] == F.col("_k"), "left").where(differs).withColumn("change", F.when(F.col("_k").isNull(), "new").otherwise("changed")).drop("_k", "_was")


def islands(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], inside: Column, least: int, ranges: int | None = None) -> DataFrame:
    """Streaks of at least ``least`` rows that are ``inside``, in order: keys, first and last order value, length.

    A streak is named by how many rows before it are outside, a running sum in two levels.
    """
    marked = rows.withColumn("_in", F.coalesce(inside, F.lit(False)))
    numbered = scan.running(marked, keys, order, ranges, _island=scan.total((~F.col("_in")).cast("long")))
    streaks = numbered.where("_in").groupBy(*keys, "_island").agg(F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"), F.count(F.lit(1)).alias("n"))
    return streaks.where(F.col("n") >= least).drop("_island")


def merged_intervals(rows: DataFrame, keys: tuple[str, ...], start: str, end: str, ranges: int | None = None) -> DataFrame:
    """Overlapping or touching intervals of each key as one: keys, start, end, n.

    An interval that begins after all before it have ended opens a group; starts rise, so
    the latest opening start names the group of a row.
    """
    by = (start, end)
    reach = scan.over(scan.ranged(rows, keys, by, ranges), keys, by, _before=scan.most(end, before=True))
    opens = F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before")), F.col(start))
    named = scan.over(reach, keys, by, _g=scan.most(opens))
    return named.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_g")

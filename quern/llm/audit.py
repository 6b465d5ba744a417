"""How filters that run one after another interact: Shapley values by multilinear extensions.

A document fails some of the filters; all that matters of it is that set, its mask. For a
part of the corpus the documents that a set of filters removes are, as a function of how
likely each filter is switched on, a polynomial that is linear in each variable: a mask's
documents stay with the product of the chances that its filters are off. Its coefficients
follow from the counts of masks. At a corner (filters on or off) its value is what that set
removes, so survivors of every prefix of every order are 2**5 values; a filter's Shapley
value is the integral of the partial derivative along the diagonal, an exact rational. So
the 120 orders never touch a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import scratch
from quern.llm import memory

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: What is counted of a part: all documents, those of good quality, toxic ones.
COUNTS = ("n", "good", "toxic")


def failures(text: Column, words: Column) -> list[Column]:
    """Whether a text fails A: under 50 words, B: distinct words under 65 %, C: A-Z over 5 % of code points, D: one of #$%&*|."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    distinct = F.size(F.array_distinct(words))
    return [F.size(words) < 50, 100 * distinct < 65 * F.size(words), 100 * capitals.cast("long") > 5 * F.length(text), text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of each part fail exactly the filters of ``mask`` (bit k: filter k).

    Filter E fails a text that a smaller doc_id of the table has as well. Equal texts are
    told by their SHA-256: the smallest id of each is an aggregate, and the rows that own
    it are found by a join on (digest, id), so a group of copies of any size is dealt by
    its ids. A null doc_id is smaller than none and has none smaller, so it passes E; rows
    that repeat the smallest id pass too. A document is good, or toxic, if any label row of
    its id says so.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("_text"))
    split = whole.withColumns({"_digest": F.unhex(F.sha2("_text", 256)), "_words": F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))})
    bits = [F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(failures(F.col("_text"), F.col("_words")))]
    narrow = split.select("_id", "part", "_digest", reduce(add, bits).alias("_mask"))
    # One pass over the texts; rows alike in all that counts become one with their number before anything is joined.
    rows = scratch.save(narrow.groupBy("_id", "_digest", "part", "_mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    first = rows.where("_id IS NOT NULL").groupBy("_digest").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    known = rows.where("_id IS NOT NULL").join(first, ["_digest", "_id"], "left")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")
    )
    labelled = known.join(marks, "_id", "left").select("part", (F.col("_mask") + F.when(F.col("_first"), 0).otherwise(16)).alias("mask"), "n", "_good", "_toxic")
    without = rows.where("_id IS NULL").select("part", F.col("_mask").alias("mask"), "n", F.lit(0).alias("_good"), F.lit(0).alias("_toxic"))
    count = lambda mark: F.sum(F.when(F.col(mark) == 1, F.col("n")).otherwise(0))
    return labelled.unionByName(without).groupBy("part", "mask").agg(F.sum("n").alias("n"), count("_good").alias("good"), count("_toxic").alias("toxic"))


def coefficients(counts: np.ndarray) -> np.ndarray:
    """Coefficients (parts x sets) of the removal polynomials of counts (parts x masks).

    The documents of mask M are removed with the chance 1 - prod(1 - x_i, i in M), whose
    monomial of a set S within M has the sign of |S| + 1.
    """
    out = counts.astype(np.int64).copy()
    size = out.shape[1]
    sets = np.arange(size)
    for bit in (1 << k for k in range(size.bit_length() - 1)):  # sums over all masks that hold the set
        lacks = sets[sets & bit == 0]
        out[:, lacks] += out[:, lacks | bit]
    sign = np.array([-1 if s.bit_count() % 2 == 0 else 1 for s in sets.tolist()])
    sign[0] = 0
    return out * sign


def corners(polynomials: np.ndarray) -> np.ndarray:
    """Their values (parts x sets) where the filters of a set are on and the others off: what the set removes."""
    out = polynomials.copy()
    sets = np.arange(out.shape[1])
    for bit in (1 << k for k in range(out.shape[1].bit_length() - 1)):
        has = sets[sets & bit != 0]
        out[:, has] += out[:, has ^ bit]
    return out


def shapley(polynomial: list[int], filters: int) -> list[Fraction]:
    """Each filter's share: the integral from 0 to 1 of the partial derivative at (t, ..., t).

    A monomial of a set S with the filter leaves t**(|S| - 1), which integrates to 1 / |S|.
    """
    return [sum((Fraction(c, s.bit_count()) for s, c in enumerate(polynomial) if s >> k & 1), Fraction(0)) for k in range(filters)]


def _evaluate(filters: int):
    wide = 1 << filters

    @memory.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, pa.Array] = {"part": batch.column("part")}
            for c in COUNTS:
                counts = batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
                polynomials = coefficients(counts)
                values = corners(polynomials)
                made[c] = pa.array(values.tolist(), pa.list_(pa.int64()))
                if c == "n":
                    made["size"] = pa.array(counts.sum(axis=1))
                    scaled = [[factorial(filters) * v for v in shapley(p, filters)] for p in polynomials.tolist()]
                    made["shapley"] = pa.array([[int(v) for v in row] for row in scaled], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({c: made[c] for c in ("part", "size", "shapley", *COUNTS)})

    return run


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, of ``counted``(part, mask, n, good, toxic).

    part, filter_order, step (from 1), kept after the step, removed at it, redundant (fail
    its filter and were removed before), unique_fails (fail its filter alone), good_lost
    and toxic_lost at it, and shapley: what its filter removes, summed over all orders. A
    part without documents has no rows; ``filters`` names them by bit, eight at most.
    """
    k, wide = len(filters), 1 << len(filters)
    if k > 8:
        raise ValueError("at most eight filters: all their orders are listed")
    # At most 2**k rows a part: its counts by mask become arrays of one row.
    held = counted.groupBy("part").agg(*(F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(wide))).alias(c) for c in COUNTS))
    values = "size long, shapley array<long>, " + ", ".join(f"{c} array<long>" for c in COUNTS)
    parts = held.mapInArrow(_evaluate(k), f"part string, {values}")
    orders = counted.sparkSession.createDataFrame(list(_orders(filters)), "filter_order string, step int, which int, before int")
    rows = parts.crossJoin(F.broadcast(orders))  # k! * k rows for each part
    at = lambda c, s: F.get(F.col(c), s)
    before, alone, every = F.col("before"), F.call_function("shiftleft", F.lit(1), F.col("which")), F.lit(wide - 1)
    after = before.bitwiseOR(alone)
    gain = lambda c: at(c, after) - at(c, before)
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("size") - at("n", after)).alias("kept"),
        gain("n").alias("removed"),
        (at("n", alone) - gain("n")).alias("redundant"),
        (at("n", every) - at("n", every.bitwiseXOR(alone))).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("which")).alias("shapley"),
    )


def _orders(filters: str) -> Iterator[tuple[str, int, int, int]]:
    """(order, step, number of its filter, mask of the filters before it)."""
    for order in permutations(filters):
        mask = 0
        for step, name in enumerate(order, 1):
            which = filters.index(name)
            yield "".join(order), step, which, mask
            mask |= 1 << which

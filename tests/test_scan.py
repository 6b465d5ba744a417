"""Running values over ranges, with most rows in one key."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import catalogue_ops as C
from quern.operators import crawl as K
from quern.operators import scan


def rows_of(seed, n=400):
    """(k, t, n, x): nine rows in ten have one key; null keys and values, no two rows alike in (k, t, n)."""
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.9 else rnd.choice(["a", "z", None]), rnd.choice([rnd.randrange(50), None]), i, rnd.choice([None, rnd.randrange(-9, 100)])) for i in range(n)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))


@pytest.mark.parametrize("ranges", [None, 7, 40])
@pytest.mark.parametrize("keys", [("k",), ()])
def test_running(spark, ranges, keys):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "k string, t int, n int, x int")
    order = ("t", "n") if keys else ("k", "t", "n")
    made = {"s": scan.total("x"), "e": scan.total("x", before=True), "m": scan.most("x"), "b": scan.most("x", before=True), "l": scan.least("x"), "p": scan.previous("x")}
    held = scan.ranged(df, keys, order, ranges)
    if ranges:
        assert held.where("k = 'hot'").select(scan.RANGE).distinct().count() > ranges // 2
    got = {r["n"]: tuple(r)[4:] for r in scan.over(held, keys, order, **made).drop(scan.RANGE).collect()}
    want, seen = {}, {}
    for k, _, n, x in ordered(rows):
        mine = seen.setdefault(k if keys else None, [])
        known = [v for v in mine if v is not None]
        now = known + [x] if x is not None else known
        of = lambda f, v: f(v) if v else None
        want[n] = (of(sum, now), of(sum, known), of(max, now), of(max, known), of(min, now), mine[-1] if mine else None)
        mine.append(x)
    assert got == want


@pytest.mark.parametrize("ranges", [None, 9])
def test_operators_on_one_hot_key(spark, ranges):
    rows = [(k, t, n, x or 0) for k, t, n, x in rows_of(2)]
    df = spark.createDataFrame(rows, "k string, t int, n int, x int")
    # Streaks of non-negative values.
    want, state = set(), {}
    for k, _, n, x in [*ordered(rows), (0, 0, 0, -1)]:
        if k not in state and state or x < 0:
            for key, run in state.items():
                if len(run) >= 3:
                    want.add((key, len(run), frozenset(run)))
            state = {}
        if x >= 0:
            state.setdefault(k, []).append(n)
    streaks = C.islands(df.withColumn("i", F.struct(F.col("t").isNotNull().alias("a"), "t", "n")), ("k",), ("i",), F.col("x") >= 0, 3, ranges)
    assert sorted((str(r["k"]), r["n"]) for r in streaks.collect()) == sorted((str(k), n) for k, n, _ in want)
    # Intervals, many of them of one key.
    rnd = random.Random(3)
    spans = [("hot" if rnd.random() < 0.9 else "a", s, s + rnd.choice([0, 1, 2, 30])) for s in (rnd.randrange(2000) for _ in range(300))]
    merged = []
    for k, s, e in sorted(spans):
        if merged and merged[-1][0] == k and s <= merged[-1][2]:
            merged[-1][2:] = [max(e, merged[-1][2]), merged[-1][3] + 1]
        else:
            merged.append([k, s, e, 1])
    got = C.merged_intervals(spark.createDataFrame(spans, "k string, s int, e int"), ("k",), "s", "e", ranges).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, merged))
    # A budget over groups, one of them large.
    left, total = [], 0
    for k, t, n, x in ordered(rows):
        total += abs(x)
        left += [(n, total)] if total <= 3000 else []
    budget = K.within_budget(df.withColumn("x", F.abs("x")), "k", ("t", "n"), "x", 3000, ranges)
    assert sorted((r["n"], r["used"]) for r in budget.collect()) == sorted(left)
    # Gaps to the end of the one before.
    close = K.spacing(spark.createDataFrame(spans, "k string, s int, e int"), "k", "s", "e", 3, ranges).collect()
    want = [(k, s, e, s - q[2]) for q, (k, s, e) in zip(sorted(spans), sorted(spans)[1:]) if q[0] == k and s - q[2] < 3]
    assert sorted((r["k"], r["s"], r["e"], r["gap"]) for r in close) == sorted(want)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, t int, x int")
    assert scan.running(df, ("k",), ("t",), s=scan.total("x")).collect() == []

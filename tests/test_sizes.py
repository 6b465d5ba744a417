"""Results and work that only larger or odd tables tell apart."""

import datetime
import random
import tracemalloc

import duckdb
import oracle
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import words as V
from quern.operators import best as N
from quern.operators import index as I
from quern.operators import search as S
from quern.operators import segments as G
from quern.operators import windows as W
from quern.operators import sections as P
from quern.plans import catalogue
from quern.streaming import event_time as T

SQL = catalogue.oracle_sql()


def differs(spark, folder, name):
    return oracle.difference(catalogue.queries()[name](spark, str(folder)), str(folder), SQL[name])


def test_intervals_of_half_seconds(spark, tmp_path):
    """Halves go to the even second, so what touches does so in Spark as in SQL."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(seconds=s), u, v) for i, (s, u, v) in enumerate([(0.5, 1, 0.1), (1.5, 1, 0.0), (7, 1, 0.5), (2.5, 2, 0.025), (3.5, 2, 0.0), (9, None, 1.0)])]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id bigint, ts timestamp, user_id bigint, value double)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY e TO '{tmp_path}/events.parquet'")
    assert differs(spark, tmp_path, "q_highlight_merge") == ""


def _asked(spark, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rnd.choices(words, range(1, 41), k=rnd.randrange(0, 30)))
    rows = [(d, k, text()) for d in range(150) for k in range(2)]
    rows += [(d, 0, "w1 w2 w39") for d in range(200, 260)] + [(None, 0, "w1"), (300, 0, None)]
    items = spark.createDataFrame(rows, "doc long, ord int, text string").repartition(5)
    terms = spark.createDataFrame([(q, rnd.choice(words)) for q in range(9) for _ in range(6)] + [(9, "absent"), (1, "w39"), (1, "w39")], "q int, term string")
    return I.build(items), terms


@pytest.mark.parametrize("cells", [1 << 20, 40])
def test_best_of_a_batch_are_those_of_all_hits(spark, monkeypatch, cells):
    """Ties by copies, repeated terms, slices of items, filters and a batch too large for the tasks: as by all hits."""
    monkeypatch.setattr(N, "CELLS", cells)
    index, terms = _asked(spark)
    seen = lambda df: sorted((r["q"], r["rank"], r["doc"], r["ord"], round(r["score"], 9)) for r in df.collect())
    allowed = spark.createDataFrame([(d,) for d in range(0, 260, 3)] + [(3,)], "doc long")
    named = spark.createDataFrame([(f"f{d % 2}", d) for d in range(0, 250)] + [("f0", 7)], "filter string, doc long")
    asks = spark.createDataFrame([(q, f"f{q % 3}") for q in range(10)], "q long, filter string")
    under = S.best_first(I.search(index, terms).join(asks, "q").join(named, ["filter", "doc"], "left_semi").drop("filter"), 10**6)
    for k in (1, 7, 500):
        assert seen(I.best(index, terms, k)) == seen(S.top(I.search(index, terms), k, F.round("score", 9).desc(), "doc", "ord"))
    assert seen(I.best(index, terms, 7, allowed)) == seen(S.top(I.search(index, terms, allowed), 7, F.round("score", 9).desc(), "doc", "ord"))
    want = seen(S.top(under.drop("rank"), 7, F.round("score", 9).desc(), "doc", "ord"))
    assert seen(I.best(index, terms, 7, named, asks)) == want
    monkeypatch.setattr(I, "MOST_TERMS", 5)
    assert seen(I.best(index, terms, 7, named, asks)) == want


def test_nearest_by_tasks_and_by_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    v = lambda: [rnd.choice([-0.5, 0.0, 0.25]) for _ in range(4)]
    items = spark.createDataFrame([(i, i % 3, v() if i % 9 else v()[:3]) for i in range(120)], "doc long, ord int, v array<double>").repartition(4)
    asked = spark.createDataFrame([(q, v(), f"f{q % 2}") for q in range(6)], "q long, v array<double>, filter string")
    named = spark.createDataFrame([(f"f{d % 2}", d) for d in range(80)], "filter string, doc long")
    both = []
    for most in (N.MOST_VECTORS, 2):
        monkeypatch.setattr(N, "MOST_VECTORS", most)
        both.append([sorted(map(tuple, N.nearest(items, asked, 8, ("doc", "ord"), a).select("q", "rank", "doc", "ord", F.round("score", 9)).collect())) for a in (None, named)])
    assert both[0] == both[1] and len(both[0][0]) == 48


def test_no_step_of_a_search_deals_pairs(spark):
    """What a batch deals is k rows a question and task, not a row for each hit."""
    index, terms = _asked(spark)
    plan = I.best(index, terms, 3)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan.split("== Physical Plan ==")[1]


class _Handle:
    def __init__(self):
        self.timers, self.calls = set(), 0

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.calls += 1

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class _Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return bool(self.v)

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    put = update

    def appendList(self, v):  # noqa: N802
        self.v = [*(self.v or []), *v]

    def clear(self):
        self.v = None


def test_a_key_has_one_timer():
    """A thousand waiting events are one timer, the earliest; it moves to the next when the watermark has passed it."""
    s = T.States(3_600_000_000)
    s.handle, s.known, s.waiting = _Handle(), _Value(), _Value()
    now = type("Times", (), {"getCurrentWatermarkInMs": lambda self: self.at, "at": 0})()
    rows = pd.DataFrame({"micros": [k * 1_000_000 for k in range(1, 1001)], "event_id": range(1000), "happened": ["other"] * 999 + ["error"]})
    assert list(s.handleInputRows((1,), iter([rows]), now)) == [] and s.handle.timers == {1000} and s.handle.calls == 1
    now.at = 500_500
    s.handle.timers.clear()
    out = list(s.handleExpiredTimer((1,), now, type("Info", (), {"getExpiryTimeInMs": lambda self: 1000})()))
    assert out[0]["n"].tolist() == [500] and s.handle.timers == {501_000} and len(s.waiting.v) == 500
    now.at = 2_000_000
    out = list(s.handleExpiredTimer((1,), now, type("Info", (), {"getExpiryTimeInMs": lambda self: 501_000})()))
    assert out[0]["state"].tolist() == ["Failed"] and 1_000_000 + 3_600_000 in s.handle.timers


def test_lines_are_trimmed_as_in_sql(spark):
    """Blanks before a line separator stay, as nothing but blanks at the ends goes."""
    rows = spark.createDataFrame([("  a \t\u00a0",), ("abc \u2028",), ("",)], "t string")
    assert [r[0] for r in rows.select(X.strip(F.col("t"))).collect()] == ["a", "abc \u2028", ""]


def test_a_block_of_vectors_is_multiplied_in_slices():
    """Two blocks of 4096 take a few MB of products at once, not hundreds."""
    v = np.random.default_rng(1).normal(size=(4096, 8))
    rows = pa.table({"q": pa.array(np.arange(4096)), "doc": pa.array(np.arange(4096)), "v": pa.array(list(v))})
    tracemalloc.start()
    found = S._scan(3, False, ("doc",))(rows, rows)
    assert found.num_rows == 3 * 4096 and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_nothing_is_dealt_for_matches_and_term_counts(spark, sf):
    plan = lambda df: df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Exchange" not in plan(catalogue.queries()["q_highlight_counts"](spark, sf))
    assert "doc_id" not in "".join(x for x in plan(catalogue.queries()["q_postings_topterms"](spark, sf)).splitlines() if "hashpartitioning" in x)
    for name in ("q_highlight_counts", "q_postings_topterms"):
        assert differs(spark, sf, name) == ""


def test_chunks_come_in_bounded_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    P.chunk_table(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 4 << 20


def test_words_found_in_bytes_are_those_of_columns(spark):
    """Every code point that the JVM knows, inside a word, alone, before and after others; nulls, empty texts and slices of an array."""
    rows = [(c, f"a{chr(c)}b {chr(c)} {chr(c)}X.É{chr(c)}") for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    known = spark.createDataFrame(pd.DataFrame(rows, columns=["c", "t"])).where(~F.rlike(F.substr("t", F.lit(2), F.lit(1)), F.lit(r"\p{Cn}")))
    seen = known.select("t", X.words(X.fold(F.col("t"))).alias("w")).toPandas()
    assert len(seen) > 280_000

    def words(texts):
        owner, word, words = V.split(texts)
        named, out = words.to_pylist(), [[] for _ in range(len(texts))]
        for i, j in zip(owner.tolist(), word.tolist(), strict=True):
            out[i].append(named[j])
        return out

    assert words(pa.array(seen["t"])) == [list(w) for w in seen["w"]]
    assert words(pa.array(["no", None, "", "Ação σΣ", "\u0301 x", "yes"]).slice(1, 4)) == [[], [], ["acao", "σσ"], ["x"]]
    assert words(pa.array([], pa.string())) == words(pa.array([None], pa.string()))[1:] == []


def test_terms_are_summed_in_tasks(spark, tmp_path, monkeypatch):
    """Sums of terms and of their shares make no row of a posting, and are the same however often a task sums up, with dead items too."""
    rnd = random.Random(8)
    rows = [(d, 0, " ".join(rnd.choices([f"w{i}" for i in range(30)], k=rnd.randrange(0, 12)))) for d in range(120)] + [(None, 0, "w1 w2"), (200, 0, None)]
    items = spark.createDataFrame(rows, "doc long, ord int, text string").repartition(3)
    index = G.add(G.build(items, f"{tmp_path}/index"), spark.createDataFrame([(d, 0, "w3 neu") for d in range(0, 120, 5)], "doc long, ord int, text string"))
    assert "Generate" not in G.by_term(index)._jdf.queryExecution().executedPlan().toString()
    seen = lambda: sorted((r["term"], r["df"], round(r["most"], 9), round(r["mean"], 9)) for r in G.by_term(index).collect())
    want = G.weights(index).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("most"), F.avg("weight").alias("mean"))
    assert seen() == sorted((r["term"], r["df"], round(r["most"], 9), round(r["mean"], 9)) for r in want.collect())
    listed = spark.createDataFrame([(["a", "b"], [1, -1]), ([], []), (["a"], [3])], "terms array<string>, n array<int>")
    for size in (1, 1 << 20):
        monkeypatch.setattr(I, "GATHERED", size)
        monkeypatch.setattr(W, "GATHERED", size)
        assert {r["term"]: r["n"] for r in I.summed(listed).collect()} == {"a": 4, "b": -1}


def test_postings_of_the_first_format_are_gathered_by_item(spark):
    """A run of an item's rows is one row; an item in two runs is two, which are put together again."""
    counts = spark.createDataFrame([("a", 1, 0, 2), ("b", 1, 0, 1), ("a", 2, 0, 1), ("c", 2, 1, 1), ("d", 1, 0, 5), ("x", None, 0, 1)], "term string, doc long, ord int, tf long").coalesce(1)
    rows = [(r["doc"], r["ord"], [tuple(t) for t in r["terms"]]) for r in G._gathered(counts).collect()]
    assert sorted(rows) == [(1, 0, [("a", 2), ("b", 1)]), (1, 0, [("d", 5)]), (2, 0, [("a", 1)]), (2, 1, [("c", 1)])]


@pytest.mark.parametrize("rows", [2, 256])
def test_vectors_pass_by_blocks_of_queries(spark, monkeypatch, rows):
    """Only the vectors are dealt more than once, once a block of queries; keys, lengths, ties, own vectors and what has no key, as by all pairs."""
    monkeypatch.setattr(S, "ROWS", rows)
    monkeypatch.setattr(S, "COLUMNS", 2 * rows)
    rnd = np.random.default_rng(5)
    table = [(i, [float(x) for x in rnd.integers(-2, 3, 3 if i % 7 else 2)], [None, "a", "b"][min(2, i % 11)]) for i in range(90)] + [(500, [], "a"), (501, None, "a")]
    v = spark.createDataFrame(table, "id long, v array<float>, key string").repartition(3)
    asks, every = v.select(F.col("id").alias("q"), "v", "key"), v.select(F.col("id").alias("doc"), "v", "key")
    for same in (False, True):
        want = []
        for q, x, key in table:
            near = [(-sum(a * b for a, b in zip(x, y, strict=True)), d) for d, y, own in table if x and y and key and own == key and len(x) == len(y) and (same or d != q)]
            want += [(q, n + 1, d, -s) for n, (s, d) in enumerate(sorted(near)[:5])]
        for block in (7, 1000):
            found = S.vector_topk(asks, every, 5, same=same, block=block)
            assert sorted((r["q"], r["rank"], r["doc"], r["score"]) for r in found.collect()) == sorted(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_items_stay_where_they_are_under_large_filters(spark, monkeypatch):
    """More documents than may go to every task do so as bitmaps; where these would be too many, or an id is negative, items are joined as before."""
    items = spark.createDataFrame([(d, 0, (d or 0) * 2) for d in [*range(0, 70_000, 7), None, -3]], "doc long, ord int, n long")
    named = spark.range(0, 70_000, 3).select(F.expr("CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END").alias("filter"), F.col("id").alias("doc"))
    named = named.union(spark.createDataFrame([("all", 7), ("all", 42), (None, 14)], "filter string, doc long"))
    seen = lambda df: sorted((r["doc"], r["ord"], r["n"], tuple(sorted(r[N.FILTERS])) if N.FILTERS in df.columns else ()) for r in df.collect())
    for allowed in (named.where("filter IS NOT NULL"), named.select("doc")):
        want = seen(N.under(items, allowed))
        with monkeypatch.context() as m:
            m.setattr(N, "MOST_TERMS", 10)
            held = N.under(items, allowed)
            assert seen(held) == want and len(want) > 3000
            assert "SortMergeJoin" not in held._jdf.queryExecution().executedPlan().toString()
            assert seen(N.under(items, allowed.union(allowed.limit(1).withColumn("doc", F.lit(-3).cast("long"))))) == sorted([*want, *seen(N.under(items, allowed.limit(1).withColumn("doc", F.lit(-3).cast("long"))))])
            m.setattr(N, "MOST_BITMAPS", 2)
            assert seen(N.under(items, allowed)) == want

"""Landing pages, script variables, bitmaps and observed counters on small cases."""

from pyspark.sql import functions as F

from quern.operators import bitmaps as M
from quern.operators import observed as O
from quern.sources import landing as N

BASE, HOST, ROOT = "https://h.example/r/Pages/home.aspx", "h.example", "/r"


def test_variables(spark):
    html = r"""<script>var __a = 'it\'s'; var __b = "x\"yé"; var __c=-12; var __d = null; var __e = true ;var __a = 'last'; var __f = "bro\ken"; nvar __g = 1; var h = 2;</script>"""
    got = spark.createDataFrame([(html,), ("none",), (None,)], "t string").select(N.variables(F.col("t")).alias("v")).collect()
    assert got[0]["v"] == {"a": "last", "b": 'x"yé', "c": "-12", "e": "true", "f": "bro\\ken"} and not got[1]["v"] and not got[2]["v"]


def test_libraries(spark):
    page = """<h4>Renda</h4><ul><li><a href="/r/cirs/Pages/x.aspx">Por verba</a><li><a href='/r/CIRS/Pages/y.aspx'>Por n&#250;mero</a><li><a href="/r/cirs/Pages/z.aspx">Por diploma</a></ul>
    <a href="/r/beneficios_fiscais/Paginas/l.aspx"> B &amp; F </a><a href="/other/x/Pages/a.aspx">no</a><a href="https://u@h.example/r/q/Pages/a.aspx">no</a><a href="/r/q/a.aspx">no</a><a href="">no</a>"""
    rows = [(1, page), (2, None), (3, ""), (4, "<h4>X</h4>" * 50)]
    got = N.libraries(spark.createDataFrame(rows, "page_id long, html string"), BASE, HOST, ROOT).orderBy("code").collect()
    assert [tuple(r) for r in got] == [
        (1, "CIRS", "Renda", "", "/r/cirs", 3, "/r/CIRS/Pages/y.aspx", "Por número", "numbered view", "Por verba|Por diploma"),
        (1, "EBF", "B & F", "", "/r/beneficios_fiscais", 1, "/r/beneficios_fiscais/Paginas/l.aspx", "B & F", "single list page", ""),
    ]
    df = spark.createDataFrame([("IVA", "/r/civa"), (" x ", "/r/selo"), (None, "/r/a")], "n string, w string")
    assert [r[0] for r in df.select(N.code(F.col("n"), F.col("w"))).collect()] == ["IVA", "SELO", "A"]


def test_bitmaps(spark):
    rows = [(d, v) for d in [0, 1, 7, 8, 32767, 32768, 70_000, 5_000_000_000] for v in ("all", "even" if d % 2 == 0 else "odd")] + [(7, "odd"), (None, "all"), (3, None)]
    sets = M.index(spark.createDataFrame(rows, "doc long, value string"))
    size = lambda s: {r["value"]: r["n"] for r in M.sizes(s).collect()}
    assert size(sets) == {"all": 8, "even": 5, "odd": 3}
    both = M.all_of(sets.where("value IN ('even', 'odd')").withColumn("value", F.lit("both")), 2)
    assert size(both) == {} and size(M.any_of(sets.withColumn("value", F.lit("any")))) == {"any": 8}
    assert size(M.within(sets, sets.where("value = 'even'"))) == {"all": 5, "even": 5}
    docs = spark.createDataFrame([(d,) for d in [0, 1, 2, 7, 8, 32767, 32768, 70_000, 5_000_000_000, None]], "doc long")
    assert sorted(r["doc"] for r in M.members(docs, sets.where("value = 'odd'")).collect()) == [1, 7, 32767]


def test_counters(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "no link"), (3, "http x"), (4, None)], "id long, reason string")
    seen, read = O.counted(df, "scan", **O.rejects("reason", {"link": "no link", "http": "http"}))
    kept, written = O.counted(seen.where("reason IS NULL"), "written")
    kept.write.parquet(f"{tmp_path}/kept")
    got = {(r["stage"], r["counter"]): r["n"] for r in O.as_rows(df, read, written).collect()}
    assert got == {("scan", "rows"): 4, ("scan", "accepted"): 2, ("scan", "link"): 1, ("scan", "http"): 1, ("written", "rows"): 2}

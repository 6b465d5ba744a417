"""Ranking, fusion, merging, metrics, passages: hand-computed cases and invariants."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quern.functions.embed import BagOfWords
from quern.operators import catalogue_ops as C
from quern.operators import crawl as K
from quern.operators import evaluation as E
from quern.operators import index as I
from quern.operators import search as S
from quern.operators import sections as P
from quern.operators.stats import nearest_rank
from quern.sources import bodies
from quern.sources import listings as L
from quern.sources import tables
from quern.streaming import incremental


def lists(spark, *ranked):
    return spark.createDataFrame([(0, n, x, i + 1) for n, items in enumerate(ranked) for i, x in enumerate(items)], "q int, list int, doc long, rank int")


def test_rrf(spark):
    rows = S.top(S.fuse(lists(spark, [10, 20, 30], [30, 10, 40])), 10, *S.fused_order()).orderBy("rank").collect()
    assert [r["doc"] for r in rows] == [10, 30, 20, 40]
    assert [r["score"] for r in rows] == pytest.approx([1 / 61 + 1 / 62, 1 / 63 + 1 / 61, 1 / 62, 1 / 63])
    rows = S.top(S.fuse(lists(spark, [2, 1], [1, 2])), 10, *S.fused_order()).orderBy("rank").collect()
    assert [r["doc"] for r in rows] == [1, 2]
    repeats = {r["doc"]: r["score"] for r in S.fuse(lists(spark, [5, 5, 6])).collect()}
    assert repeats[6] == pytest.approx(1 / 62)


def test_bm25_counts_terms_that_fold_alike_twice(spark):
    docs = spark.createDataFrame([(1, "acao"), (2, "casa"), (3, "casa fria"), (4, "rua")], "doc_id long, text string")
    both = S.terms_of(spark.createDataFrame([(0, "ação acao"), (1, "acao")], "id int, text string"), "id", "text")
    score = {r["q"]: r["score"] for r in S.bm25(docs, both).collect()}
    assert score[0] == pytest.approx(2 * score[1])


def test_filters_act_before_the_cut_and_after_statistics(spark):
    docs = spark.createDataFrame([(i, "casa" if i < 5 else "casa rua") for i in range(6)] + [(9, "mar")] * 1, "doc_id long, text string")
    terms = spark.createDataFrame([(0, "casa"), (0, "rua")], "q int, term string")
    allowed = spark.createDataFrame([(4,)], "doc long")
    only = S.best_first(S.bm25(docs, terms, allowed), 1).collect()
    free = {r["doc"]: r["score"] for r in S.bm25(docs, terms).collect()}
    assert [r["doc"] for r in only] == [4] and only[0]["score"] == pytest.approx(free[4])


def test_canonical(spark):
    rows = [(1, "a", 0, "h"), (2, "b", 1, "h"), (3, "a", 0, "h"), (4, "b", 1, None), (5, "c", 2, None), (6, "b", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, source string, precedence int, sha string")
    assert {r["doc_id"]: r["canonical_id"] for r in C.canonical(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_upsert_keeps_and_replaces(spark):
    old = spark.createDataFrame([(1, "a", "k1"), (2, "b", "k2")], "id long, name string, chunk_key string")
    new = spark.createDataFrame([(2, "B", "x"), (3, "c", "y")], "id long, name string, chunk_key string")
    got = {tuple(r) for r in C.upsert(old, new, "id", keep=("chunk_key",)).collect()}
    assert got == {(1, "a", "k1"), (2, "B", "k2"), (3, "c", "y")}
    assert C.replace_group(old, new, "id").count() == 3
    assert [t.count() for t in C.delete_cascade(new, "id", (old, "id"))] == [1]


def test_streaks_and_intervals(spark):
    rows = spark.createDataFrame([("u", i, x) for i, x in enumerate("ffofffo")], "k string, t int, s string")
    assert [(r["first_at"], r["n"]) for r in C.islands(rows, ("k",), ("t",), F.col("s") == "f", 3).collect()] == [(3, 3)]
    spans = spark.createDataFrame([("u", 0, 5), ("u", 5, 7), ("u", 9, 10)], "k string, s int, e int")
    assert {(r["s"], r["e"], r["n"]) for r in C.merged_intervals(spans, ("k",), "s", "e").collect()} == {(0, 7, 2), (9, 10, 1)}


def test_metrics(spark):
    want = spark.createDataFrame([(q, "x") for q in range(4)], "q int, doc string")
    ranked = spark.createDataFrame([(0, "x", 1), (1, "x", 3), (2, "x", 11)], "q int, doc string, rank int")
    m = E.metrics(E.outcomes(ranked, want)).first()
    assert (m["recall"], m["answered"], m["questions"]) == (0.5, 2, 4) and m["mrr"] == pytest.approx((1 + 1 / 3) / 4, abs=1e-6)


def test_question_rules(spark):
    rows = [("1", "a", ["x"]), ("1", "b", ["x", "x"]), ("2", "a", []), ("", " ", [""]), ("3", "z" * 501, ["y"])]
    got = {(r["id"], r["rule"]) for r in E.violations(spark.createDataFrame(rows, "id string, question string, expected array<string>")).collect()}
    assert got == {
        ("1", "id used twice"), ("1", "expected id twice"), ("1", "question used twice"), ("2", "question used twice"), ("2", "nothing expected"),
        ("", "no id"), ("", "no question"), ("", "empty expected id"), ("3", "question too long"),
    }


def test_sections_and_empty_heading(spark):
    bodies = [
        "Cabeça\nConteúdo: Assunto aqui\nPEDIDO:\nFACTOS\nAlgo aconteceu.\nCONCLUSÃO\nFim.",
        "só texto",
        "",
        None,
        "CONTEUDO: FACTOS\nx\nINFORMAÇÃO",
        "PEDIDO\nCONCLUSÃO\n  ",
        "x Conteúdo: y",
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    got = {}
    for r in P.section_table(df).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r["doc_id"], []).append((r["section"], (bodies[r["doc_id"]] or "")[r["start"] : r["end"]]))
    assert got == {
        0: [("header", "Cabeça"), ("request", "Assunto aqui"), ("facts", "PEDIDO:\nFACTOS\nAlgo aconteceu."), ("conclusion", "CONCLUSÃO\nFim.")],
        1: [("content", "só texto")],
        4: [("facts", "FACTOS\nx"), ("legal-framework", "INFORMAÇÃO")],
        5: [("conclusion", "PEDIDO\nCONCLUSÃO")],
        6: [("content", "x Conteúdo: y")],
    }


def count_tokens(text):
    return len(re.findall(P.TOKEN, text))


@pytest.mark.parametrize("seed", range(6))
def test_passages_are_greedy(seed):
    """Each passage holds whole units, cannot take the next one, and begins as early as the overlap allows."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "bom", "dia-a-dia", "é", "x" * 30, "3,14", "ab-" * 60])
    body = "".join(" ".join(word() for _ in range(rnd.randrange(1, 30))) + rnd.choice([". ", "; ", "\n", "?  ", ".\n"]) for _ in range(60)).strip()
    limit, overlap, overhead = rnd.choice([(40, 10, 2), (60, 0, 2), (100, 25, 5)])
    parts = P.passages(body, [("content", 0, len(body))], limit, overlap, overhead)
    assert [k for k, *_ in parts] == list(range(len(parts))) and parts[0][2] == 0 and parts[-1][3] == len(body)
    ends = {m.start() for m in re.finditer(P.SENTENCE_END, body)} | {len(body)}
    for _, _, a, b, n in parts:
        assert n == count_tokens(body[a:b]) + overhead <= limit and body[a:b] == body[a:b].strip()
    for (_, _, a, b, _), (_, _, c, d, _) in zip(parts, parts[1:]):
        assert a < c and b < d or c == b or d == b  # a long word may follow a passage that is only overlap
        assert count_tokens(body[c:b]) <= overlap
        # What follows b: the rest of a word that was cut, else at least one more unit, which did not fit.
        after = len(body[b:]) - len(body[b:].lstrip()) + b
        sentence = min((e for e in ends if e > after), default=len(body))
        unit = body[after:sentence]
        whole = limit - overhead if overlap == 0 else overlap
        if after > b and count_tokens(unit) <= whole:
            assert count_tokens(body[a:sentence]) + overhead > limit


def test_token_starts():
    rnd = random.Random(1)
    for _ in range(300):
        body = "".join(rnd.choice("aZ9_é漢٣²½ⅷ \t\u00a0\u2003\n.,-—😀\u0301") for _ in range(rnd.randrange(60)))
        assert P.token_starts(body).tolist() == [m.start() for m in re.finditer(P.TOKEN, body)]


def test_passages_of_long_texts_take_linear_time():
    for body in ("a" * 1_000_000, "ab-" * 330_000, "palavra " * 120_000, "a. " * 300_000):
        began = time.process_time()
        parts = P.passages(body, [("content", 0, len(body.rstrip()))])
        assert time.process_time() - began < 3 and parts[-1][3] == len(body.rstrip())
        assert all(t <= 512 for *_, t in parts)


def test_chunk_table(spark):
    rows = [(1, " ".join(f"Frase número {i} com algumas palavras a mais." for i in range(120))), (2, None), (None, "um dois"), (2, "PEDIDO\nx. y")]
    got = P.chunk_table(spark.createDataFrame(rows, "doc_id long, text string"), 128, 24).collect()
    assert {(r["doc_id"], r["section"]) for r in got} == {(1, "content"), (None, "content"), (2, "request")}
    assert all(r["text"] == dict((t, t) for _, t in rows if t).get(r["text"], r["text"]) for r in got) and sum(r["doc_id"] == 1 for r in got) >= 5
    assert all(any(t and t[r["start"] : r["end"]] == r["text"] for _, t in rows) for r in got)


def test_marks_and_excerpts():
    assert P.merge([(0, 3), (3, 5), (10, 60), (-5, -3), (4, 4), (6, 7)], 20).tolist() == [[0, 5], [6, 7], [10, 20]]
    assert P.merge([], 5).tolist() == []
    rnd = random.Random(3)
    for _ in range(200):
        text = " ".join(rnd.choice(["um", "alvo", "dois", "tresquatro"]) for _ in range(rnd.randrange(1, 90)))
        marks = P.merge(P.highlights(text, ["Álvo"]), len(text))
        assert [text[a:b] for a, b in marks] == re.findall("alvo", text)
        size = rnd.randrange(20, 120)
        a, b = P.excerpt_window(text, marks, size)
        # By the definition: every window that a mark opens, and the first one.
        inside = lambda x, y: sum(x <= s and e <= y for s, e in marks.tolist())
        options = [(max(0, s - P.LEAD_IN), min(len(text), max(0, s - P.LEAD_IN) + size)) for s, _ in marks.tolist()]
        most = max([inside(0, size) + P.MORE - 1, *(inside(*w) for w in options)])
        want = next((w for w in options if inside(*w) == most and most > inside(0, size) + P.MORE - 1), (0, size)) if len(text) > size else (0, len(text))
        assert want[0] <= a <= b <= want[1] and (a == want[0] or text[a - 1] == " " and " " not in text[want[0] : a - 1])
        assert b == want[1] or text[b] == " "
        parts = P.segments(text, marks, a, b)
        assert "".join(t for t, _ in parts) == text[a:b] and all(("alvo".startswith(t) or "alvo".endswith(t) or t in "alvo") == m or m for t, m in parts if m)


def test_excerpt_table(spark):
    rows = [(1, 5, "um\ndois  alvo " * 40, ["alvo"]), (2, 6, None, ["x"])]
    got = {r["q"]: r for r in P.excerpt_table(spark.createDataFrame(rows, "q long, doc_id long, text string, terms array<string>"), 60).collect()}
    assert got[1]["after"] and not got[1]["before"] and "".join(s["text"] for s in got[1]["segments"]).replace(" ", "") == got[1]["excerpt"].replace(" ", "")
    assert [s["text"] for s in got[1]["segments"] if s["mark"]] == ["alvo"] * got[1]["marks"]
    assert (got[2]["start"], got[2]["end"], got[2]["segments"]) == (0, 0, [])


def test_index_is_kept_up_to_date(spark):
    rows = [(1, 0, "um dois dois"), (1, 1, "tres"), (2, 0, None), (3, 0, "Dóis quatro")]
    df = spark.createDataFrame(rows, "doc long, ord int, text string")
    index = I.build(df)
    terms = spark.createDataFrame([(7, "dois"), (7, "tres"), (8, "nada")], "q long, term string")
    weights = lambda i: {(r["term"], r["doc"], r["ord"]): round(r["weight"], 9) for r in i.postings.collect()}
    found = {(r["q"], r["doc"], r["ord"]): r["score"] for r in I.search(index, terms).collect()}
    assert set(found) == {(7, 1, 0), (7, 1, 1), (7, 3, 0)} and found[7, 1, 0] > found[7, 3, 0] * 0.99
    assert {(r["q"], r["doc"]) for r in I.search(index, terms, spark.createDataFrame([(3,)], "doc long")).collect()} == {(7, 3)}
    now = [(1, 0, "novo texto"), (2, 0, "dois"), (4, 0, "cinco")]
    after = I.update(index, spark.createDataFrame(now, "doc long, ord int, text string"), spark.createDataFrame([(3,)], "doc long"))
    assert weights(after) == weights(I.build(spark.createDataFrame(now, "doc long, ord int, text string")))
    assert {r["term"] for r in after.counts.collect()} == {"novo", "texto", "dois", "cinco"}


@pytest.mark.parametrize("small", [2, 20_000])
def test_nearest_rank(spark, small):
    rnd = random.Random(7)
    rows = [(k, rnd.choice([1.5, 2.5, rnd.random() * 100, 7.0])) for k in "abc" for _ in range(rnd.randrange(1, 60))] + [("same", 3.0)] * 5 + [("far", x) for x in [1e12, *map(float, range(100))]] + [("none", None), (None, 4.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["x"], r["y"]) for r in nearest_rank(df, "k", "v", {"x": 0.5, "y": 0.95}, cells=4, small=small).collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        v = sorted(x for n, x in rows if n == k and x is not None)
        want[k] = tuple(v[max(1, -(-len(v) * p // 100)) - 1] for p in (50, 95))
    assert got == want


def test_bag_of_words(spark):
    df = spark.createDataFrame([("Ação ação de",), ("",), (None,), ("xy",)], "t string").select(BagOfWords(16).embed(F.col("t")).alias("v"))
    a, b, c, d = (r["v"] for r in df.collect())
    assert sum(x > 0 for x in a) == 1 and max(a) == pytest.approx(1) and b == c == d == [0.0] * 16

    def fnv(word):
        h = 2166136261
        for x in word.encode():
            h = (h ^ x) * 16777619 % 2**32
        return h

    assert a[fnv("acao") % 16] == pytest.approx(1)


def test_crawl(spark):
    assert K.follow(K.PENDING, ["text", "fetched", "error", "text", "retry", "fetched", "no text", "again", "text"]) == K.EXTRACTED
    items = spark.createDataFrame([("b", 1, 5), ("a", 2, 3), ("a", 1, 4), (None, 9, 1)], "s string, i int, n int")
    got = {(r["s"], r["i"]): r["used"] for r in K.within_budget(items, "s", ("i",), "n", 8).collect()}
    assert got == {(None, 9): 1, ("a", 1): 5, ("a", 2): 8}
    with pytest.raises(K.DuplicateId):
        K.require_unique(items, "s")
    assert K.require_unique(items, "n") is items
    with pytest.raises(ValueError):
        K.allowed_by_listing(items, None, "1")


def test_listings_with_malformed_answers(spark):
    df = lambda *j: spark.createDataFrame([("l", x) for x in j], "library string, json string")
    for bad in ("{}", "[]", "no", None, '{"data": {}}', '{"data": "["}'):
        with pytest.raises(L.ListingError):
            L.rows_of(df('{"data": []}', bad))
    rows = L.rows_of(df('{"data": [["a", 1, null, {"x": 2}, "\\u00e9"], 5, "text", {"a": 1}, []]}')).orderBy("row").collect()
    assert [r["cells"] for r in rows] == [["a", "", "", "", "é"], None, None, None, []]
    assert L.rows_of(df('{"data": []}')).count() == 0


def test_outcomes_by_class_equal_those_by_pairs(spark):
    rnd = random.Random(2)
    items = [(i, rnd.randrange(5)) for i in range(40)] + [(99, 77)]
    ranked = [(q, d, r + 1) for q, _ in items for r, d in enumerate(rnd.sample([i for i, _ in items if i != q], 15))]
    a = spark.createDataFrame(items, "id long, class int")
    b = spark.createDataFrame(ranked, "q long, doc long, rank long")
    pairs = spark.createDataFrame([(x, y) for x, k in items for y, n in items if k == n and x != y], "q long, doc long")
    assert E.metrics(E.outcomes_by_class(b, a)).first() == E.metrics(E.outcomes(b, pairs)).first()


def test_documents_of_many_lines(spark):
    """Passages are (document, line) pairs, so long documents do not run into the next."""
    lists = spark.createDataFrame([(1, 0, (5, 100_001), 5, 1), (1, 0, (6, 1), 6, 2)], "q long, list int, chunk struct<doc: long, ord: int>, doc long, rank long")
    assert {(r["doc"], r["chunk"]["ord"]) for r in S.one_passage(lists).collect()} == {(5, 100_001), (6, 1)}


def test_manifests_and_bodies(spark, tmp_path):
    good = '{"version": 1, "source": "s", "entries": [{"id": "a-1", "file": "a-1.txt", "sha": "x"}]}'
    (tmp_path / "good.json").write_text(good + "\n")
    assert [tuple(r) for r in bodies.manifest(spark, str(tmp_path / "good.json")).collect()] == [("s", "a-1", "a-1.txt", "x")]
    for name, text in (("version", good.replace("1,", "2,", 1)), ("missing", good.replace('"version": 1, ', "")), ("id", good.replace("a-1", "A/1"))):
        (tmp_path / f"{name}.json").write_text(text + "\n")
        with pytest.raises(Exception, match="manifest version|not an id"):
            bodies.manifest(spark, str(tmp_path / f"{name}.json")).collect()
    (tmp_path / "a-1.txt").write_text("linha um\nlinha dois\n", encoding="utf-8")
    assert [tuple(r) for r in bodies.bodies(spark, str(tmp_path)).collect()] == [("a-1", "linha um\nlinha dois\n")]


def test_questions_that_can_be_asked(spark):
    df = spark.createDataFrame([(1, "a"), (2, "  "), (3, None)], "q long, t string")
    assert [r["q"] for r in S.askable(df, "t", 5).collect()] == [1] and S.askable(df, "t", 0).count() == 0


def test_streamed_index_of_null_texts(spark, tmp_path):
    rows = [(1, "a"), (2, None), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    for generation in (0, 1):
        incremental.build(spark, f"{tmp_path}/docs", f"{tmp_path}/index", "s", generation)
    assert spark.read.parquet(f"{tmp_path}/index/data").count() == 3
    assert incremental.read_index(spark, f"{tmp_path}/index").count() == 3
    spark.createDataFrame(rows[:1], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/docs2")
    incremental.remove_absent(spark, f"{tmp_path}/docs2", f"{tmp_path}/index", 1)
    assert [r["doc_id"] for r in incremental.read_index(spark, f"{tmp_path}/index").collect()] == [1]


def test_streamed_index_is_compacted(spark, tmp_path):
    folder = f"{tmp_path}/index"
    rows = [(i, f"text {i}") for i in range(200)] + [(None, "x")]
    put = lambda name, r: spark.createDataFrame(r, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}")
    put("a", rows)
    put("b", [(i, f"text {i}" if i % 3 else "new") for i in range(5, 220)] + [(None, "x")])
    incremental.build(spark, f"{tmp_path}/a", folder, "s")
    incremental.build(spark, f"{tmp_path}/b", folder, "s", 1)
    incremental.remove_absent(spark, f"{tmp_path}/b", folder, 1)
    now = lambda: sorted(map(str, incremental.read_index(spark, folder).collect()))
    before = now()
    assert len(before) == 216
    one = spark.createDataFrame([(7, "t")], "doc_id long, text string")
    assert [r["doc_id"] for r in incremental.read_index(spark, folder, one).collect()] == [7]
    plan = incremental.read_index(spark, folder, one)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan)  # a batch reads the folders of its own documents
    for _ in range(2):
        incremental.compact(spark, folder)
        assert now() == before
    assert spark.read.parquet(f"{folder}/data").select("batch").distinct().count() == 1
    incremental.build(spark, f"{tmp_path}/a", folder, "s", 2)
    assert len(now()) == 221
    incremental.compact(spark, f"{tmp_path}/nothing")


def test_declared_schema(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "item_id long, text int").write.parquet(f"{tmp_path}/benchmark.parquet")
    with pytest.raises(tables.SchemaError):
        tables.table(spark, str(tmp_path), "benchmark")


def test_vector_topk_over_blocks(spark):
    rows = [(i, [float(i % 7 - 3), float(i % 5 - 2)], i % 2) for i in range(60)]
    q = spark.createDataFrame(rows, "q long, v array<double>, key int")
    d = q.withColumnRenamed("q", "doc")
    got = {}
    for r in S.vector_topk(q, d, 4, block=8).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["doc"])
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1]
    for i, v, k in rows:
        others = sorted((j for j, _, n in rows if n == k and j != i), key=lambda j: (-dot(v, rows[j][1]), j))
        assert got[i] == others[:4]

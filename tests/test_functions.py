"""Hand-computed cases of the scalar functions."""

import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import urls as U
from quern.functions import vectors as V
from quern.operators import sections as P


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def many(spark, cases, f):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in rows] == [b for _, b in cases]


def test_terms(spark):
    many(
        spark,
        [
            ('despesas AND "educação" NEAR filhos*', ["despesas", "and", "educação", "near", "filhos"]),
            ("de a", ["de", "a"]),
            ("!?", []),
            ("", []),
            ("'; DROP TABLE x --", ["drop", "table", "x"]),
            (" ".join(f"w{i}" for i in range(40)), [f"w{i}" for i in range(32)]),
        ],
        X.query_terms,
    )


def test_match_expression(spark):
    assert one(spark, "casa fria", lambda c: X.match_expression(X.query_terms(c))) == '"casa" OR "fria"'
    assert one(spark, "...", lambda c: X.match_expression(X.query_terms(c))) is None


def test_articles(spark):
    many(spark, [("010", "10"), ("012-B", "12-B"), ("012 -B ", "12-B"), (" 012", " 012"), ("0236", "236"), ("000", "0"), ("", ""), ("Art. único", "Art. único")], X.normalize_article)
    many(spark, [("78-D", "78.º-D"), ("13", "13.º"), ("Verba 1.12", "Verba 1.12")], X.article_label)
    many(spark, [("78-D", 78), ("x", 2147483647), ("123456789", 2147483647)], X.article_number)


def test_headings(spark):
    many(
        spark,
        [
            ("PEDIDO", "request"),
            ("I. O PEDIDO:", "request"),
            ("FACTOS", "facts"),
            ("2 - DESCRIÇÃO DOS FACTOS", "facts"),
            ("CONCLUSÃO", "conclusion"),
            ("INFORMAÇÃO", "legal-framework"),
            ("Enquadramento legal", "legal-framework"),
            ("pedido", None),
            ("O pedido foi entregue ontem.", None),
            ("ABC", None),
        ],
        X.heading,
    )


def test_body(spark):
    body = "FICHA DOUTRINÁRIA\n  Um texto \n\n1Processo: 25359\nProcesso: 2210/2010  1\nOutro texto"
    assert one(spark, body, X.normalize_body) == "Um texto\nOutro texto"


def test_process(spark):
    many(
        spark,
        [
            ("Processo: 2184/03  1\nProcesso: 31329, com despacho de 2026-09-22, x", "31329"),
            ("Processo: 2184/03  1\nfim", "2184/03"),
            ("nada", None),
        ],
        X.process_number,
    )
    many(
        spark,
        [("com despacho de 2026-09-22, x", datetime.date(2026, 9, 22)), ("despacho da Diretora de 05.05.2010", datetime.date(2010, 5, 5)), ("despacho de 2010-13-45", None), ("", None)],
        X.decision_date,
    )


def test_ids(spark):
    many(spark, [("PIV_31329.pdf", "piv_31329"), ("Açã o  1.PDF", "aca-o-1"), ("con.pdf", "con_")], X.file_id)
    assert one(spark, "???.pdf", X.file_id).startswith("ruling-")
    assert len(one(spark, "a" * 150, X.file_id)) == 109
    many(spark, [("abc_1", True), ("A", False), ("", False), ("nul", False)], X.is_valid_id)


def test_text_helpers(spark):
    assert one(spark, "<b>x</b>&nbsp;&amp;lt;  y", X.html_text) == "x &lt; y"
    assert one(spark, "a. b; c", X.sentences) == ["a.", "b;", "c"]
    assert one(spark, "a1 - b", X.count_words) == 2
    assert one(spark, "a\r\nb­c \x00", X.clean_extracted) == "a\nb-c"
    folds = [("ȘTEFAN Ação", "stefan acao"), ("é ASCII", "e ascii"), ("PLAIN", "plain"), ("", ""), (None, None), ("Å한", "a\u1112\u1161\u11ab"), ("cafe\u0301", "cafe"), ("Čaj ő Ș ž", "caj o s z")]
    many(spark, [*folds, ("ΟΔΟΣ ς", "οδοσ ς"), ("İ K", "i k"), ("😀é", "😀e"), ("a\u0301\u0302b", "ab")], X.fold)
    many(spark, [("Ação", "ACAO"), ("cafe\u0301", "CAFE"), (None, None), ("x", "X")], X.fold_upper)
    many(spark, [("cafe\u0301", "caf\u00e9"), ("ﬁ①", "ﬁ①"), (None, None)], lambda c: X.normalized(c, "NFC"))
    many(spark, [("caf\u00e9 cafe\u0301 CAFE\u0301", ["caf\u00e9"]), ("na\u0303o é", ["não", "é"])], X.query_terms)
    many(spark, [("ﬁle①.pdf", "file1"), ("Čaj.pdf", "caj"), ("C\u030caj ő.PDF", "caj-o"), ("½.pdf", "1-2")], X.file_id)
    every = "".join(chr(i) + "b" for i in range(1, 0x30000) if unicodedata.ucd_3_2_0.category(chr(i)) not in ("Cn", "Cs") and not (0xAC00 <= i < 0xD7A4 and i % 50))
    assert one(spark, every, X.fold) == P.fold(every)
    assert one(spark, "https://h/x/Caf%65%CC%81.pdf", U.file_key) == "caf\u00e9.pdf"


def test_entities(spark):
    cases = [("&#65;&#x42;&#X1F600;&#0;&#xD800;&#1114112;", "AB😀&#0;&#xD800;&#1114112;"), ("a &amp;lt; &#233;t&#xe9; &nope;", "a &lt; été &nope;"), ("&# &#x; &#12", "&# &#x; &#12")]
    many(spark, cases, X.decode_entities)


def test_documents_rules(spark):
    text = '![a](one.png) ![b](<two three.png> "t")\n<IMG alt=x src="four.svg">\n[five]: <five.JPG>\n[six]: six.txt'
    assert one(spark, text, X.image_references) == ["one.png", "two three.png", "four.svg", "five.JPG"]
    assert one(spark, "---\na: 1\nb: 'two' \na: \"3\"\n not: x\n---\nbody", X.front_matter) == {"a": "3", "b": "two"}
    assert one(spark, "no block\n---\na: 1\n---", X.front_matter) is None
    assert one(spark, "IRS", lambda c: X.filter_summary(c, F.lit(""), F.lit("2020"))) == "IRS · 2020" and one(spark, "", X.filter_summary) == "none"


def test_urls(spark):
    base = F.lit("https://h.pt/lib/a/list.aspx?x=1/2")
    cases = [("/p/a.pdf", "https://h.pt/p/a.pdf"), ("b c.pdf", "https://h.pt/lib/a/b%20c.pdf"), ("//o.pt/x", "https://o.pt/x"), ("http://o.pt/é", "http://o.pt/%C3%A9"), ("", None), ("javascript:x", None)]
    many(spark, cases, lambda c: U.resolve(base, c))
    many(spark, [("https://h.pt/A%20b+c.PDF?x", "a b+c.pdf"), ("https://h.pt/%zz.pdf", "%zz.pdf")], U.file_key)
    many(spark, [("http://h.pt/a", "uses http, not https"), ("https://x.pt/a", "leaves the allowlisted host"), ("https://h.pt/a", None)], lambda c: U.verdict(c, F.lit("h.pt")))
    got = one(spark, "https://h.pt/s?q=a+b%20c&article=5&year=20x4", U.search_parameters, "string")
    assert tuple(got) == ("a b c", None, None, None)
    assert tuple(one(spark, "/?tax=IRS&article=%205&year=2020", U.search_parameters)) == (None, "IRS", "5", "2020")


@pytest.mark.parametrize(
    "url, ok",
    [("https://h.pt/a.pdf", True), ("http://h.pt/a", False), ("https://h.pt:8443/a", False), ("https://u@h.pt/a", False), ("https://x.pt/a", False), ("junk", False)],
)
def test_url_policy(spark, url, ok):
    assert one(spark, url, lambda c: U.is_allowed(c, F.lit("H.pt"))) is ok


def test_robots(spark):
    cases = [("/a", "/a/b", True), ("/*.pdf$", "/x/y.pdf", True), ("/*.pdf$", "/x/y.pdf?z", False), ("/a$", "/ab", False), ("", "/a", False), ("/a_b", "/axb", False), ("/a%20b", "/a b/c", True), ("/a b", "/a%20b", True), ("/50%", "/50%/x", True), ("/x\\y", "/x\\y", True)]
    df = spark.createDataFrame([(i, p, u) for i, (p, u, _) in enumerate(cases)], "i int, rule string, path string")
    rows = df.select("i", U.robots_matches(F.col("path"), F.col("rule")).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in rows] == [m for *_, m in cases]


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], V.normalize, "array<float>") == pytest.approx([0.6, 0.8])
    assert one(spark, [0.0, 0.0], V.normalize, "array<float>") == [0.0, 0.0]


def test_resolved_urls(spark):
    base = "https://h.example/a/b/page.aspx?x=1#top"
    cases = [
        ("../x.pdf", "https://h.example/a/x.pdf"), ("../../../x.pdf", "https://h.example/x.pdf"), ("./c/./d/..", "https://h.example/a/b/c/"), ("/p/../q/", "https://h.example/q/"),
        ("?q=1", "https://h.example/a/b/page.aspx?q=1"), ("#end", "https://h.example/a/b/page.aspx?x=1#end"), ("/a b[1].pdf", "https://h.example/a%20b%5B1%5D.pdf"),
        ("/50%.pdf", "https://h.example/50%25.pdf"), ("/a%20b.pdf", "https://h.example/a%20b.pdf"), ("é.pdf", "https://h.example/a/b/%C3%A9.pdf"), ("\\c\\d.pdf", "https://h.example/c/d.pdf"),
        ("//o.example/x", "https://o.example/x"), ("HTTPS://O.example/../y|z", "HTTPS://O.example/y%7Cz"), ("x.pdf?a=[1]", "https://h.example/a/b/x.pdf?a=%5B1%5D"), ("...", "https://h.example/a/b/..."),
        ("", None), ("mailto:a@b.c", None), ("a//b", "https://h.example/a/b/a//b"), (".", "https://h.example/a/b/"), (None, None),
    ]
    many(spark, cases, lambda c: U.resolve(F.lit(base), c))
    many(spark, [("https://h.example:443/x", "y"), ("https://h.example:8443/x", "n"), ("https://u@h.example/x", "n"), ("https://H.EXAMPLE/x", "y")], lambda c: F.when(U.is_allowed(c, F.lit("h.example")), "y").otherwise("n"))

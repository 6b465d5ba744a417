"""Table functions called from SQL."""

import pytest
from pyspark.errors import AnalysisException, PySparkException

from quern.functions import tables
from quern.operators import sections as P

BODIES = [
    "Cabeça 😀\nConteúdo: Assunto aqui\nPEDIDO:\nFACTOS\nAlgo aconteceu.\nCONCLUSÃO\nFim.", "só texto", "", None, "CONTEÚDO: FACTOS\nx\nINFORMAÇÃO", "PEDIDO\nCONCLUSÃO\n  ", "x Conteúdo: y",
    " ".join(f"Frase número {i} com palavras a mais." for i in range(60)), "  \u00a0II - DESCRIÇÃO DOS FACTOS\u00a0\nabc\npedido\nO\u0301 PEDIDO",
]


@pytest.fixture(scope="module")
def docs(spark):
    tables.register(spark)
    return spark.createDataFrame(list(enumerate(BODIES)), "doc_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_sections_and_chunks_equal_the_dataframe_operators(spark, docs):
    assert rows(spark.sql("SELECT d.doc_id, s.* FROM {d} d, LATERAL sections(d.text) s", d=docs)) == rows(P.section_table(docs))
    got = spark.sql("SELECT d.doc_id, c.* FROM {d} d, LATERAL chunks(d.text, max_tokens => 40, overlap => 8) c", d=docs)
    assert rows(got) == rows(P.chunk_table(docs, 40, 8)) and got.count() > 15
    found = P.with_headings(docs).collect()
    for r in found:
        assert P.outline(r["text"]) == ((r["label_from"], r["label_to"]), [(h["line"], h["name"]) for h in r["headings"]])


def test_highlights_and_segments(spark, docs):
    got = rows(spark.sql("SELECT h.* FROM VALUES ('Ação, acao\u0301 e AÇÃO', array('acao', NULL)), (NULL, array('x')), ('x', NULL) v(t, w), LATERAL highlights(v.t, v.w) h"))
    assert got == [(0, 4, "Ação"), (6, 11, "acao\u0301"), (14, 18, "AÇÃO")]
    parts = spark.sql("SELECT s.* FROM VALUES ('um\talvo dois  alvo') v(t), LATERAL segments(v.t, array('alvo')) s ORDER BY 1").collect()
    assert [tuple(r) for r in parts] == [(0, "um ", False), (1, "alvo", True), (2, " dois ", False), (3, "alvo", True)]


@pytest.mark.parametrize("call", ["sections(1)", "chunks('a', max_tokens => 10, overlap => 9)", "chunks('a', max_tokens => 'x')", "highlights('a', 'b')", "segments('a', array('b'), size => -1)"])
def test_arguments_are_checked_when_the_query_is_analysed(spark, docs, call):
    with pytest.raises((AnalysisException, PySparkException)):
        spark.sql(f"SELECT * FROM {call}").schema

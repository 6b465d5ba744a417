"""Passages with their vectors beside the postings: hybrid search of a batch of questions, each under its own filter.

A filter is a name that a question carries and a table of (filter, doc): it acts on the
keyword list and on the vector list before either is cut, while statistics stay those of
all passages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import scratch
from quern.functions.embed import Embedder
from quern.operators import best as N
from quern.operators import index as I
from quern.operators import search as S
from quern.sources.tables import spread


@dataclass(frozen=True)
class Passages:
    """table: (doc, ord, text, v) of every passage, v null where nothing could be embedded; index: their postings."""

    table: DataFrame
    index: I.Index
    embedder: Embedder

    @property
    def written(self) -> list[DataFrame]:
        return [self.table, *self.index.written]


def _embedded(rows: DataFrame, embedder: Embedder) -> DataFrame:
    v = F.when(F.exists("v", lambda x: x != 0), F.col("v"))
    return spread(rows).withColumn("v", embedder.embed(F.col("text"))).withColumn("v", v)


def build(items: DataFrame, embedder: Embedder) -> Passages:
    """Written passages of ``items``(doc long, ord int, text), embedded once and indexed."""
    table = scratch.save(_embedded(items.select("doc", "ord", "text"), embedder), "passages")
    return Passages(table, I.build(table.select("doc", "ord", "text")), embedder)


def search(passages: Passages, questions: DataFrame, allowed: DataFrame | None = None, pool: int = S.POOL, limit: int = S.LIMIT) -> DataFrame:
    """(q, doc, ord, rank, score, text): the best ``limit`` documents of each of ``questions``(q, text), each with its best passage.

    With ``allowed``(filter, doc) the questions carry a ``filter`` too, and only documents
    allowed under it take part; a question whose filter allows nothing has no answer.
    Passages are ranked by keywords and by vectors, ``pool`` of each, and fused.
    """
    chosen = None if allowed is None else allowed.select("filter", "doc").where("filter IS NOT NULL").distinct()
    if chosen is not None:
        questions = questions.where("filter IS NOT NULL")
    asks = None if allowed is None else questions
    keyword = I.best(passages.index, S.terms_of(questions, "q", "text"), pool, chosen, asks)
    asked = _embedded(questions, passages.embedder).where("v IS NOT NULL")
    held = passages.table.where("v IS NOT NULL").select("doc", "ord", "v")
    near = N.nearest(held, asked, pool, ("doc", "ord"), chosen).where("score > 0")
    found = scratch.save(S.passage_search(keyword, near, pool, limit).select("q", "doc", F.col("chunk.ord").alias("ord"), "rank", "score"), "found")
    few = found.limit(I.MOST_TERMS + 1).count() <= I.MOST_TERMS
    return passages.table.select("doc", "ord", "text").join(F.broadcast(found) if few else found, ["doc", "ord"]).select("q", "doc", "ord", "rank", "score", "text")

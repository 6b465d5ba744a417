"""Search over chunks, each question under its own filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import scratch
from quern.functions import text as X
from quern.operators import bitmaps as M
from quern.operators import passages as R
from quern.operators import sections as P
from quern.plans.registry import query
from quern.plans.retrieval import _ASKED, PASSAGES_SQL, passages_of
from quern.plans.structure import CHUNKS_CTE
from quern.sources.tables import table

_CHUNKS = "l AS MATERIALIZED (SELECT doc_id AS doc, ordinal AS ord, passage AS line FROM chunks)"


def chunk_passages(spark: SparkSession, d: str) -> R.Passages:
    """Chunks of every normalised body as passages."""

    def items() -> DataFrame:
        docs = table(spark, d, "documents").select("doc_id", X.normalize_body(F.col("text")).alias("text"))
        return P.chunk_table(docs).select(F.col("doc_id").alias("doc"), F.col("ordinal").alias("ord"), "text")

    return passages_of(spark, d, "chunks", items)


def _answers(found: DataFrame) -> DataFrame:
    return found.select("q", "doc", "ord", "rank", F.round("score", 6).alias("score"), F.md5("text").alias("passage"))


@query(f"WITH RECURSIVE {CHUNKS_CTE}, {_ASKED}, {_CHUNKS}, {PASSAGES_SQL.replace('WHERE_OK', '')}")
def q_chunk_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of at most 512 tokens: keyword and vector lists of them, fused to documents, each with its best chunk."""
    return _answers(R.search(chunk_passages(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")))


_OK = "WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = doc AND CASE q % 3 WHEN 0 THEN lower(d.lang) = 'en' WHEN 1 THEN d.doc_id % 5 = 2 AND year(DATE '2015-01-01' + (d.doc_id % 3650)::int) < 2020 ELSE d.source = 'src1' END)"


@query(f"WITH RECURSIVE {CHUNKS_CTE}, {_ASKED}, {_CHUNKS}, {PASSAGES_SQL.replace('WHERE_OK', _OK)}")
def q_chunk_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same with a filter for each question, by language, by listing and year, or by source: it acts on both lists before they are cut."""
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    published = F.expr("date_add(DATE'2015-01-01', cast(doc_id % 3650 as int))")
    names = F.array(
        F.when(F.lower("lang") == "en", "english"),
        F.when((n % 5 == 2) & (F.year(published) < 2020), "listed before 2020"),
        F.when(F.col("source") == "src1", "first source"),
    )
    allowed = docs.select(n.alias("doc"), F.explode(F.array_compact(names)).alias("filter"))
    which = F.element_at(F.array(*map(F.lit, ("english", "listed before 2020", "first source"))), (F.col("q") % 3 + 1).cast("int"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text").withColumn("filter", which)
    return _answers(R.search(chunk_passages(spark, d), asked, allowed))


@query(f"WITH RECURSIVE {CHUNKS_CTE}, {_ASKED}, {_CHUNKS}, {PASSAGES_SQL.replace('WHERE_OK', _OK)}")
def q_chunk_search_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """The filtered search with its filters made from bitmaps of languages, listings, years and sources."""
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    year = F.year(F.expr("date_add(DATE'2015-01-01', cast(doc_id % 3650 as int))"))
    values = F.array(F.concat(F.lit("lang="), F.lower("lang")), F.concat(F.lit("listing="), (n % 5).cast("string")), F.when(year < 2020, "before 2020"), F.concat(F.lit("source="), "source"))
    sets = scratch.save(M.index(docs.select(n.alias("doc"), F.explode(F.array_compact(values)).alias("value"))), "bitmaps")
    take = lambda value, name: sets.where(F.col("value") == value).withColumn("value", F.lit(name))
    listed = M.all_of(take("listing=2", "listed before 2020").unionByName(take("before 2020", "listed before 2020")), 2)
    filters = take("lang=en", "english").unionByName(listed).unionByName(take("source=src1", "first source"))
    allowed = M.members(docs.select(n.alias("doc")), filters).withColumnRenamed("value", "filter")
    which = F.element_at(F.array(*map(F.lit, ("english", "listed before 2020", "first source"))), (F.col("q") % 3 + 1).cast("int"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text").withColumn("filter", which)
    return _answers(R.search(chunk_passages(spark, d), asked, allowed))

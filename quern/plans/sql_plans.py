"""Queries in SQL over registered table functions, and what Spark's collations and observed metrics give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import scratch
from quern.functions import tables
from quern.functions import text as X
from quern.operators import bitmaps as M
from quern.operators import crawl as K
from quern.operators import observed as O
from quern.operators import search as S
from quern.plans.listing_plans import ENTRIES_SQL, scanned
from quern.plans.registry import SQL, query
from quern.plans.retrieval import BM25_CTE, bm25
from quern.plans.structure import _marked
from quern.sources.tables import table


#: Counters of rejected rows by how their reasons begin.
REASONS = {
    "shape": "unexpected shape",
    "no_link": "no PDF link",
    "invalid_link": "invalid PDF link",
    "http": "PDF link uses http",
    "other_host": "PDF link leaves the allowlisted host",
    "no_pdf": "link is not a PDF",
}


@query(SQL["q_sections"])
def q_sql_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections by the table function in a lateral join."""
    tables.register(spark)
    docs = table(spark, d, "documents").select("doc_id", F.array_join(_marked(), "\n").alias("text"))
    return spark.sql("SELECT d.doc_id, s.* FROM {docs} d, LATERAL sections(d.text) s", docs=docs)


@query(SQL["q_chunk_pack"])
def q_sql_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by the table function, with its limits given by name."""
    tables.register(spark)
    docs = table(spark, d, "documents").select("doc_id", X.normalize_body(F.col("text")).alias("text"))
    sql = "SELECT d.doc_id, c.ordinal, c.section, c.start, c.`end`, c.token_count, md5(c.text) AS passage FROM {docs} d, LATERAL chunks(d.text, max_tokens => 512, overlap => 64) c"
    return spark.sql(sql, docs=docs)


_WORDS_SQL = "string_split(trim(regexp_replace(d.text, '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g')), ' ')"


@query(f"""WITH {BM25_CTE}, h AS (SELECT q, doc FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM bm25) WHERE rank <= 3),
w AS (SELECT h.q, h.doc AS doc_id, unnest({_WORDS_SQL}) AS w FROM h JOIN documents d ON d.doc_id = h.doc)
SELECT q, doc_id, w AS word, count(*)::bigint AS n FROM w JOIN (SELECT DISTINCT * FROM terms) t USING (q) WHERE strip_accents(lower(w)) = term GROUP BY ALL""")
def q_sql_highlights(spark: SparkSession, d: str) -> DataFrame:
    """Words of the three best documents of each question that match its terms, by the table function."""
    tables.register(spark)
    hits = bm25(spark, d, 3).select("q", F.col("doc").alias("doc_id"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), X.query_terms(F.col("text")).alias("terms"))
    found = table(spark, d, "documents").select("doc_id", "text").join(S.shared(hits.join(asked, "q")), "doc_id")
    return spark.sql("SELECT f.q, f.doc_id, h.word, count(*) AS n FROM {found} f, LATERAL highlights(f.text, f.terms) h GROUP BY ALL", found=found)


@query(f"""WITH {BM25_CTE}, h AS (SELECT q, doc FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM bm25) WHERE rank <= 1)
SELECT q, doc AS doc_id, length(regexp_replace(regexp_replace(d.text, '[\r\n\t]', ' ', 'g'), ' {{2,}}', ' ', 'g')) > 0 AS shown, (SELECT count(*) FROM (SELECT unnest({_WORDS_SQL}) AS w) WHERE strip_accents(lower(w)) IN (SELECT term FROM terms WHERE terms.q = h.q))::bigint AS marks FROM h JOIN documents d ON d.doc_id = h.doc""")
def q_sql_segments(spark: SparkSession, d: str) -> DataFrame:
    """The best document of each question in marked and plain parts: an excerpt as long as any text has all its marks."""
    tables.register(spark)
    hits = bm25(spark, d, 1).select("q", F.col("doc").alias("doc_id"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), X.query_terms(F.col("text")).alias("terms"))
    found = table(spark, d, "documents").select("doc_id", "text").join(S.shared(hits.join(asked, "q")), "doc_id")
    sql = "SELECT f.q, f.doc_id, sum(length(s.text)) > 0 AS shown, count_if(s.mark) AS marks FROM {found} f, LATERAL segments(f.text, f.terms, size => 100000000) s GROUP BY ALL"
    return spark.sql(sql, found=found)


_LABELS_SQL = "SELECT DISTINCT lang, w FROM (SELECT lang, unnest(string_split(trim(regexp_replace(text, '[^\\p{L}]+', ' ', 'g')), ' ')) AS w FROM documents) WHERE length(w) >= 3"


@query(f"WITH l AS ({_LABELS_SQL}) SELECT lang, w AS label, row_number() OVER (PARTITION BY lang, strip_accents(lower(w[1])) ORDER BY w COLLATE en, w) AS place FROM l")
def q_labels_by_locale(spark: SparkSession, d: str) -> DataFrame:
    """Words of each language in the order of its readers, within their first letters: marks and case matter last."""
    w = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}{3,}"), F.lit(0))))
    labels = table(spark, d, "documents").select("lang", w.alias("label")).distinct()
    first = X.fold(F.substr("label", F.lit(1), F.lit(1)))
    place = F.row_number().over(Window.partitionBy("lang", first).orderBy(F.collate("label", "UNICODE"), "label"))
    return labels.select("lang", "label", place.cast("long").alias("place"))


@query("""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS library, CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE 'a' END || doc_id % 4 AS article FROM documents),
m AS (SELECT lower(library) AS k, count(*) AS n FROM labels JOIN l USING (doc_id) GROUP BY 1)
SELECT lower(library) AS library, count(*)::bigint AS n, count(*) FILTER (lower(article) = 'a2')::bigint AS in_article, coalesce(max(m.n), 0)::bigint AS labelled FROM l LEFT JOIN m ON k = lower(library) GROUP BY lower(library)""")
def q_nocase_facets(spark: SparkSession, d: str) -> DataFrame:
    """Libraries and articles written in either case: grouped, filtered and joined by a collation that ignores it."""
    nocase = lambda c: F.collate(c, "UTF8_LCASE")
    n = F.col("doc_id")
    library = F.when(n % 2 == 0, F.upper("source")).otherwise(F.col("source"))
    article = F.concat(F.when(n % 3 == 0, "A").otherwise("a"), (n % 4).cast("string"))
    listed = table(spark, d, "documents").select("doc_id", nocase(library).alias("library"), nocase(article).alias("article"))
    facets = listed.groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("article") == F.collate(F.lit("A2"), "UTF8_LCASE")).alias("in_article"))
    marked = table(spark, d, "labels").join(listed, "doc_id").groupBy("library").agg(F.count(F.lit(1)).alias("labelled"))
    joined = facets.join(marked, "library", "left")
    return joined.select(F.lower(F.collate("library", "UTF8_BINARY")).alias("library"), "n", "in_article", F.coalesce("labelled", F.lit(0)).alias("labelled"))


@query(f"""WITH {ENTRIES_SQL}, k AS (SELECT count(*) AS rows, count(*) FILTER (reject_reason IS NULL) AS accepted, {", ".join(f"count(*) FILTER (starts_with(reject_reason, '{start}')) AS {k}" for k, start in REASONS.items())} FROM e)
SELECT 'scan' AS stage, counter, n::bigint AS n FROM (UNPIVOT k ON COLUMNS(*) INTO NAME counter VALUE n)
UNION ALL SELECT 'written', 'rows', count(*) FROM e WHERE reject_reason IS NULL""")
def q_listing_counters(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a listing scan reads, rejects by each reason and writes, counted by the job that writes them."""
    scan, read = O.counted(scanned(spark, d), "scan", **O.rejects("reject_reason", REASONS))
    kept, written = O.counted(scan.where("reject_reason IS NULL"), "written")
    kept.write.parquet(scratch.folder(spark, "accepted"))
    return O.as_rows(kept, read, written)


@query("""SELECT CASE k WHEN 0 THEN 'source' ELSE 'lang' END || '=' || CASE k WHEN 0 THEN source ELSE lang END AS value, count(*)::bigint AS n FROM documents, (VALUES (0), (1)) v(k)
WHERE (doc_id % 5 = 2 OR doc_id % 5 = 4) AND year(DATE '2015-01-01' + (doc_id % 3650)::int) < 2020 AND n_chars > 500 GROUP BY ALL""")
def q_bitmap_facets(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each source and language among documents of two articles, before 2020, above a length: unions and intersections of bitmaps."""
    n = F.col("doc_id")
    year = F.year(F.expr("date_add(DATE'2015-01-01', cast(doc_id % 3650 as int))")).cast("string")
    docs = table(spark, d, "documents")
    named = lambda kind, c: F.concat(F.lit(f"{kind}="), c)
    values = F.array(named("source", F.col("source")), named("lang", F.col("lang")), named("article", (n % 5).cast("string")), named("year", year), F.when(F.col("n_chars") > 500, "long"))
    sets = scratch.save(M.index(docs.select(n.alias("doc"), F.explode(F.array_compact(values)).alias("value"))), "bitmaps")
    part = lambda condition, name: M.any_of(sets.where(condition).withColumn("value", F.lit(name)))
    filters = part("value IN ('article=2', 'article=4')", "article").unionByName(part("value LIKE 'year=%' AND value < 'year=2020'", "year")).unionByName(part("value = 'long'", "long"))
    chosen = M.all_of(filters.withColumn("value", F.lit("filter")), 3)
    return M.sizes(M.within(sets.where("value LIKE 'source=%' OR value LIKE 'lang=%'"), chosen))


@query("""WITH v AS (SELECT doc_id, translate(replace(text, 'e', '-'), chr(9) || chr(11) || chr(12) || chr(133) || chr(160) || chr(8195), '      ') AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(replace(t, chr(13), chr(10)), ' +\\n', chr(10), 'g'), ' +$', '', 'g')) AS body FROM v""")
def q_clean_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Texts as a PDF reader gives them (soft hyphens, line ends of three kinds, odd blanks) made plain again."""
    n, text = F.col("doc_id"), F.replace(F.col("text"), F.lit("e"), F.lit("\u00ad"))
    ends = F.when(n % 3 == 0, F.replace(text, F.lit("\n"), F.lit(" \r\n"))).when(n % 3 == 1, F.replace(text, F.lit("\n"), F.lit("\u2003\r"))).otherwise(F.replace(text, F.lit("\n"), F.lit("\t\n")))
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_extracted(ends)).alias("body"))


@query("""SELECT doc_id, CASE WHEN len(l) = 0 THEN 'all' ELSE array_to_string(l, ' · ') END AS summary FROM (SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN lang END, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END, CASE WHEN n_chars > 900 THEN 'long' END], lambda x: x IS NOT NULL AND x <> '') AS l FROM documents)""")
def q_filter_summary(spark: SparkSession, d: str) -> DataFrame:
    """What a document's filters say, in one line."""
    n = F.col("doc_id")
    parts = (F.when(n % 2 == 0, F.col("lang")), F.when(n % 3 == 0, F.col("source")).otherwise(""), F.when(F.col("n_chars") > 900, "long"))
    return table(spark, d, "documents").select("doc_id", X.filter_summary(*parts, default="all").alias("summary"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '  ' ELSE NULL END AS t FROM conversations) WHERE trim(t) <> ''")
def q_askable(spark: SparkSession, d: str) -> DataFrame:
    """Turns that can be asked as questions: the others are blank or null."""
    t = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, "  ")
    return S.askable(table(spark, d, "conversations").withColumn("t", t), "t", 10).select("conv_id", "turn")


@query("SELECT source, count(*)::bigint AS n FROM documents GROUP BY source")
def q_unique_ids(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source, after their ids are known to be unique."""
    return K.require_unique(table(spark, d, "documents"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"))

"""The data side of a crawl and of an incremental index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import scratch
from quern.functions import urls as U
from quern.operators import catalogue_ops as C
from quern.operators import crawl as K
from quern.operators import search as S
from quern.plans.registry import query
from quern.plans.retrieval import BM25_CTE, bm25
from quern.sources import bodies
from quern.sources.tables import table
from quern.streaming import event_time, incremental


@query("""SELECT doc_id, state FROM (SELECT doc_id, source IS NOT NULL AS listed, (['Pending', 'Downloaded', 'Extracted', 'ScannedSkipped', 'Failed'])[1 + doc_id % 5] AS state FROM documents) WHERE state IN ('Pending', 'Downloaded', 'Failed')""")
def q_crawl_wanted(spark: SparkSession, d: str) -> DataFrame:
    """Entries that a run with retries takes up."""
    state = F.element_at(F.array(*map(F.lit, K.STATES)), (1 + F.col("doc_id") % 5).cast("int"))
    return K.wanted(table(spark, d, "documents").select("doc_id", state.alias("state")), retry_failed=True)


@query("""SELECT doc_id FROM documents WHERE doc_id % 5 = 2 AND doc_id % 7 > 0""")
def q_crawl_indexable(spark: SparkSession, d: str) -> DataFrame:
    """Entries that are listed and extracted."""
    state = F.element_at(F.array(*map(F.lit, K.STATES)), (1 + F.col("doc_id") % 5).cast("int"))
    return K.indexable(table(spark, d, "documents").select("doc_id", state.alias("state"), (F.col("doc_id") % 7 > 0).alias("listed"))).select("doc_id")


@query("SELECT doc_id, doc_id % 3 = 0 AS is_pdf FROM documents")
def q_pdf_magic(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that begin as a PDF."""
    body = F.concat(F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7\n").otherwise("%PD"), "text")
    return table(spark, d, "documents").select("doc_id", K.is_pdf(F.encode(body, "UTF-8")).alias("is_pdf"))


@query("SELECT l_orderkey, l_linenumber::bigint AS l_linenumber, least(0.5 * pow(2, l_linenumber), 20.0)::double AS seconds, round_even(l_quantity / 8, 1)::double AS one, round_even(l_quantity / 8, 2)::double AS two FROM lineitem")
def q_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Waiting times by attempt, and half-even rounding."""
    q = F.col("l_quantity") / 8
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), K.backoff(F.col("l_linenumber"), 0.5, 20.0).alias("seconds"), F.bround(q, 1).alias("one"), F.bround(q, 2).alias("two"))


@query("WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (ORDER BY source, doc_id ROWS UNBOUNDED PRECEDING)::bigint AS used FROM documents) SELECT source, doc_id, used FROM r WHERE used <= (SELECT sum(n_chars) FROM documents) * 0.4")
def q_download_budget(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a budget shared by all sources, in their order, admits: two fifths of all characters."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    total = docs.agg(F.sum("n_chars")).first()[0] or 0
    return K.within_budget(docs, "source", ("doc_id",), "n_chars", total * 0.4).select("source", "doc_id", F.col("used").cast("long").alias("used"))


@query("SELECT coalesce(n.conv_id, c.conv_id) AS conv_id, md5(coalesce(n.t, c.t)) AS body, n.t IS NULL AS from_cache FROM (SELECT conv_id, min(text) AS t FROM conversations WHERE role = 'user' AND conv_id % 3 > 0 GROUP BY 1) n FULL JOIN (SELECT conv_id, min(text) AS t FROM conversations GROUP BY 1) c USING (conv_id)")
def q_cached_fallback(spark: SparkSession, d: str) -> DataFrame:
    """New answers, or cached ones where a request brought none."""
    c = table(spark, d, "conversations")
    new = c.where("role = 'user' AND conv_id % 3 > 0").groupBy("conv_id").agg(F.min("text").alias("text"))
    out = K.newest_or_cached(new, c.groupBy("conv_id").agg(F.min("text").alias("text")), "conv_id", "text")
    return out.select("conv_id", F.md5("text").alias("body"), "from_cache")


@query("""WITH e AS (SELECT user_id, event_id, epoch(ts)::bigint AS s, epoch(ts)::bigint + value::bigint AS z FROM events)
SELECT user_id, event_id, s - lag(z) OVER w AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, z) QUALIFY gap < 300""")
def q_spacing_from_end(spark: SparkSession, d: str) -> DataFrame:
    """Events that begin less than five minutes after the end of the user's one before."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + 0.5).cast("long")
    e = table(spark, d, "events").select("user_id", "event_id", at.alias("s"), (at + F.rint("value")).cast("long").alias("z"))
    return K.spacing(e, "user_id", "s", "z", 300).select("user_id", "event_id", "gap")


@query("SELECT source, 'd' || doc_id AS id, sha256(text) AS sha FROM documents")
def q_manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as manifests of a thousand entries at most, scanned and checked again."""
    n = F.floor(F.col("doc_id") / 1000)
    entry = F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.sha2("text", 256).alias("sha"))
    parts = table(spark, d, "documents").groupBy("source", n.alias("n")).agg(F.collect_list(entry).alias("entries"))
    path = f"{scratch.scratch_dir(spark)}/{incremental.fresh_name('manifest')}"
    parts.select(F.lit(bodies.VERSION).alias("version"), "source", "entries").write.json(path)
    return bodies.manifest(spark, path).select("source", "id", "sha")


@query("SELECT label::bigint AS label, count(*)::bigint AS questions, sum(len(embedding))::bigint AS expected FROM embeddings GROUP BY 1")
def q_question_counts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as questions that expect their components: how many questions and expected values each class has."""
    return table(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("questions"), F.sum(F.size("embedding")).cast("long").alias("expected"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS q, url, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) ORDER BY page_id) AS rank FROM pages),
k AS (SELECT * FROM p WHERE rank <= 10 AND url LIKE 'https://%' AND page_id % 7 > 0)
SELECT q, count(*)::bigint AS n, '[' || string_agg('{"rank":' || rank || ',"id":"' || page_id || '","title":"page ' || page_id || '","url":"' || url || '","score":' || rank / 8 || '}', ',' ORDER BY rank) || ']' AS body FROM k GROUP BY q""")
def q_responses(spark: SparkSession, d: str) -> DataFrame:
    """Ten pages of each host as a search's answer: hits without title or with another scheme are left out."""
    p = table(spark, d, "pages").select(U.part(F.col("url"), "HOST").alias("q"), F.col("page_id").alias("id"), "url", F.when(F.col("page_id") % 7 > 0, F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("title"))
    return S.responses(S.top(p, 10, "id").withColumn("score", F.col("rank") / 8))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS q, url, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) ORDER BY page_id) AS rank FROM pages),
k AS (SELECT * FROM p WHERE rank <= 3 AND url LIKE 'https://%')
SELECT q, count(*)::bigint AS n, '[' || string_agg('{"rank":' || rank || ',"id":"' || page_id || '","title":"t","url":"' || url || '","score":' || rank / 8 || ',"passage":"page ' || page_id || '","highlights":[{"start":0,"length":4}' || CASE WHEN page_id >= 100 THEN ',{"start":5,"length":3}' ELSE '' END || ']}', ',' ORDER BY rank) || ']' AS body FROM k GROUP BY q""")
def q_responses_marked(spark: SparkSession, d: str) -> DataFrame:
    """Answers with passages and highlights: one that reaches beyond its passage, begins before it, or is empty is dropped."""
    p = table(spark, d, "pages").select(U.part(F.col("url"), "HOST").alias("q"), F.col("page_id").alias("id"), "url", F.lit("t").alias("title"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("passage"))
    mark = lambda a, n: F.struct(F.lit(a).alias("start"), F.lit(n).alias("length"))
    marks = F.array(mark(0, 4), mark(5, 3), mark(-1, 2), mark(2, 0), mark(90, 1))
    return S.responses(S.top(p.withColumn("highlights", marks), 3, "id").withColumn("score", F.col("rank") / 8))


_KEYS_SQL = "r AS (SELECT doc_id AS id, sha256('v1' || chr(10) || text) AS want FROM documents WHERE doc_id % 11 > 0), s AS (SELECT doc_id AS id, sha256('v1' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN 'old ' ELSE '' END || text) AS chunk_key, 3 AS chunks, CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 3 END AS vectors FROM documents WHERE doc_id % 6 > 0)"


@query(f"""WITH {_KEYS_SQL} SELECT coalesce(r.id, s.id) AS id, CASE WHEN r.id IS NULL THEN 'remove' WHEN s.id IS NOT NULL AND chunk_key = want AND vectors = chunks THEN 'current'
WHEN (SELECT lower(source) FROM documents d WHERE d.doc_id = r.id) IN ('src1', 'src2', 'src3') THEN 'index' ELSE 'left' END AS action FROM r FULL JOIN s ON r.id = s.id""")
def q_index_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a build of three libraries does with each document: index, leave, remove, or nothing."""
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    key = lambda text: F.sha2(F.concat(F.lit("v1\n"), text), 256)
    rulings = docs.where(n % 11 > 0).select(n.alias("id"), key(F.col("text")).alias("chunk_key"))
    older = F.concat(F.when(n % 4 == 0, "old ").otherwise(""), "text")
    states = docs.where(n % 6 > 0).select(n.alias("id"), key(older).alias("chunk_key"), F.lit(3).alias("chunks"), F.when(n % 13 == 0, 2).otherwise(3).alias("vectors"))
    return K.plan(rulings, states, docs.select(n.alias("id"), F.col("source").alias("library")), ("SRC1", "src2", "Src3"))


@query("SELECT lang AS value, count(*)::bigint AS n FROM documents GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('pt', NULL::bigint), ('xx', NULL)) WHERE col0 NOT IN (SELECT lang FROM documents)")
def q_facet_options(spark: SparkSession, d: str) -> DataFrame:
    """Languages with their numbers, and chosen ones that no document has."""
    facets = table(spark, d, "documents").groupBy(F.col("lang").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return K.facet_options(facets, spark.createDataFrame([("pt",), ("en",), ("xx",)], "value string"))


@query(f"""WITH {BM25_CTE}, ok AS (SELECT * FROM bm25 WHERE doc IN (SELECT doc_id FROM documents WHERE lower('LIB' || (doc_id % 3)) = 'lib1' AND lower('a' || (doc_id % 5)) = 'a2')),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM ok) SELECT q, doc, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def q_bm25_by_listing(spark: SparkSession, d: str) -> DataFrame:
    """BM25 among documents that a library lists under an article, case ignored; statistics are those of all documents."""
    n = F.col("doc_id")
    listings = table(spark, d, "documents").select(n.alias("doc"), F.concat(F.lit("LIB"), (n % 3).cast("string")).alias("library"), F.concat(F.lit("a"), (n % 5).cast("string")).alias("article"))
    return bm25(spark, d, S.LIMIT, K.allowed_by_listing(listings, "lib1", "A2")).select("q", "doc", "rank", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT doc_id, lang, n_chars, 'key' || doc_id AS chunk_key FROM documents WHERE doc_id % 4 > 0)
SELECT d.doc_id, d.lang, d.n_chars + 1 AS n_chars, c.chunk_key FROM documents d LEFT JOIN c USING (doc_id) WHERE d.doc_id % 3 = 0
UNION ALL SELECT doc_id, lang, n_chars, chunk_key FROM c WHERE doc_id % 3 > 0""")
def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    """New rows over old ones; the chunk key of a known row stays."""
    docs, n = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), F.col("doc_id")
    old = docs.where(n % 4 > 0).withColumn("chunk_key", F.concat(F.lit("key"), n.cast("string")))
    return C.upsert(old, docs.where(n % 3 == 0).withColumn("n_chars", F.col("n_chars") + 1), "doc_id", keep=("chunk_key",))


_TURNS_SQL = "SELECT conv_id, turn, md5(text) AS body FROM conversations"


@query(f"{_TURNS_SQL} WHERE conv_id % 3 > 0 UNION ALL SELECT conv_id, turn, md5('new ' || text) FROM conversations WHERE conv_id % 3 = 0 AND turn % 2 = 0")
def q_replace_group(spark: SparkSession, d: str) -> DataFrame:
    """All turns of some conversations give way to new ones, fewer of them."""
    c = table(spark, d, "conversations")
    new = c.where("conv_id % 3 = 0 AND turn % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    return C.replace_group(c.select("conv_id", "turn", "text"), new.select("conv_id", "turn", "text"), "conv_id").select("conv_id", "turn", F.md5("text").alias("body"))


@query(f"SELECT conv_id, turn, md5(text) AS body FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn > 3)")
def q_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Turns without those of conversations that are deleted."""
    c = table(spark, d, "conversations")
    return C.delete_cascade(c.where("turn > 3").select("conv_id").distinct(), "conv_id", (c, "conv_id"))[0].select("conv_id", "turn", F.md5("text").alias("body"))


_HAPPENED = {"view": "fetched", "click": "text", "purchase": "again", "signup": "retry", "error": "error"}
_STEP_SQL = " ".join(f"WHEN s.state = '{a}' AND e.happened = '{h}' THEN '{b}'" for (a, h), b in K.STEPS.items())


@query(f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _HAPPENED.items())} END AS happened FROM events),
s AS (SELECT DISTINCT user_id, 0 AS n, 'Pending' AS state FROM e
UNION ALL SELECT s.user_id, s.n + 1, CASE {_STEP_SQL} ELSE s.state END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, max_by(state, n) AS state, max(n)::bigint AS n FROM s GROUP BY user_id""")
def q_crawl_states(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as happenings of an entry: the state that a stateful stream ends in."""
    return incremental.crawl_states(spark, f"{d}/events.parquet", _HAPPENED)


@query("""SELECT doc_id, sha256('v2' || chr(10) || coalesce(text, '')) AS chunk_key, length(coalesce(text, ''))::bigint AS size FROM documents""")
def q_incremental_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A stream builds the index of older documents, then of the present ones; what is gone is removed."""
    return incremental.refresh(spark, f"{d}/documents.parquet", "v2")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts)::bigint AS moment, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _HAPPENED.items())} END AS happened FROM events),
r AS (SELECT DISTINCT user_id, 0 AS n, 'Pending' AS state, NULL::bigint AS failed FROM e
UNION ALL SELECT user_id, n, state, CASE WHEN state = 'Failed' THEN coalesce(failed, moment) END FROM
  (SELECT s.user_id, e.n, e.moment AS moment, s.failed, CASE {_STEP_SQL} ELSE s.state END AS state FROM
    (SELECT r.user_id, r.n, CASE WHEN r.state = 'Failed' AND r.failed + 21600000000 <= f.moment THEN 'Pending' ELSE r.state END AS state,
       CASE WHEN r.state = 'Failed' AND r.failed + 21600000000 <= f.moment THEN NULL ELSE r.failed END AS failed FROM r JOIN e f ON f.user_id = r.user_id AND f.n = r.n + 1) s
    JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT user_id, CASE max_by(state, n) WHEN 'Failed' THEN 'Pending' ELSE max_by(state, n) END AS state, max(n)::bigint AS n FROM r GROUP BY user_id""")
def q_crawl_states_by_time(spark: SparkSession, d: str) -> DataFrame:
    """States by event time of events that come up to two hours late; a failure is taken up again after six hours."""
    what = F.create_map(*(F.lit(x) for pair in _HAPPENED.items() for x in pair))
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.coalesce(F.try_element_at(what, F.col("event_type")), F.lit("")).alias("happened"))
    folder = scratch.folder(spark, "late")
    event_time.write_out_of_order(events, folder, 7200)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return event_time.states_by_time(spark, stream, "2 hours", 6)

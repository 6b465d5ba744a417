"""Merged entries, index status, manifests, crawl logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import catalogue_ops as C
from quern.operators.stats import nearest_rank
from quern.plans.registry import query
from quern.sources.tables import CORPUS_SQL, corpus, table

_CANON = f"""WITH {CORPUS_SQL}, m AS (SELECT *, min(precedence) OVER (PARTITION BY sha) AS mr FROM corpus),
canon AS (SELECT *, CASE WHEN sha IS NULL OR precedence IS NULL OR precedence = mr THEN doc_id
  ELSE min(CASE WHEN precedence = mr THEN doc_id END) OVER (PARTITION BY sha) END AS canonical_id FROM m)"""


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return C.canonical(corpus(spark, d).drop("text"))


@query(f"{_CANON} SELECT doc_id, source, canonical_id FROM canon")
def q_dedup_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The canonical document of every entry."""
    return _canonical(spark, d).select("doc_id", "source", "canonical_id")


@query("SELECT sha256(text) AS sha, count(*)::bigint AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def q_cross_source_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Contents that several sources list."""
    e = corpus(spark, d).groupBy("sha", "source").agg(F.count(F.lit(1)).alias("n"))
    out = e.groupBy("sha").agg(F.sum("n").alias("n"), F.sort_array(F.collect_set("source")).alias("s"))
    return out.where(F.size("s") > 1).select("sha", "n", F.array_join("s", ",").alias("sources"))


@query(f"{_CANON} SELECT source, count(*)::bigint AS entries, count(*) FILTER (canonical_id <> doc_id)::bigint AS merged FROM canon GROUP BY source")
def q_merged_count(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each source and how many are merged into another's."""
    return _canonical(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("canonical_id") != F.col("doc_id")).alias("merged"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose canonical document has a passage, which is one with text."""
    e = _canonical(spark, d)
    held = corpus(spark, d).where(F.length("text") > 0).select(F.col("doc_id").alias("canonical_id"))
    return e.join(held, "canonical_id", "left_semi")


_HELD = "held AS (SELECT * FROM canon c WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.canonical_id AND length(d.text) > 0))"


@query(f"{_CANON}, {_HELD} SELECT source, count(DISTINCT canonical_id)::bigint AS n FROM held WHERE trim(source) <> '' GROUP BY source")
def q_facet_source(spark: SparkSession, d: str) -> DataFrame:
    """Distinct documents of each source."""
    return _held(spark, d).where(F.trim("source") != "").groupBy("source").agg(F.countDistinct("canonical_id").alias("n"))


@query(f"{_CANON}, {_HELD} SELECT source, lang, coalesce(try_cast(nullif(regexp_extract(substr(source, 4), '^([0-9]{{1,8}})(?:[^0-9]|$)', 1), '') AS int), 2147483647)::bigint AS number, count(DISTINCT canonical_id)::bigint AS n FROM held WHERE trim(lang) <> '' GROUP BY ALL")
def q_facet_source_lang(spark: SparkSession, d: str) -> DataFrame:
    """Distinct documents of each source and language, with the source's number to sort by."""
    number = X.article_number(F.expr("substr(source, 4)")).cast("long")
    return _held(spark, d).where(F.trim("lang") != "").groupBy("source", "lang", number.alias("number")).agg(F.countDistinct("canonical_id").alias("n")).orderBy("source", "number", "lang")


@query(f"{_CANON} SELECT year(published_on)::bigint AS year, count(*)::bigint AS n FROM canon WHERE canonical_id = doc_id GROUP BY 1")
def q_facet_year(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each year, newest first."""
    own = _canonical(spark, d).where("canonical_id = doc_id").groupBy(F.year("published_on").cast("long").alias("year"))
    return own.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("year"))


_SETTINGS = "chunker v1, max 512, overlap 64|test|64"


@query(f"SELECT doc_id, sha256('{_SETTINGS}' || chr(10) || text) AS chunk_key FROM documents")
def q_content_hash_key(spark: SparkSession, d: str) -> DataFrame:
    """The key under which a document's passages stay current."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.lit(_SETTINGS + "\n"), "text"), 256).alias("chunk_key"))


@query("""SELECT coalesce(event_type, 'total') AS state, count(*)::bigint AS n, count(*) FILTER (value > 50)::bigint AS large, (count(*) FILTER (event_type = 'error') = 0) AS is_complete
FROM events GROUP BY ROLLUP (event_type)""")
def q_corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each state and in total."""
    e = table(spark, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("large"), (F.count_if(F.col("event_type") == "error") == 0).alias("is_complete"))
    return e.select(F.coalesce("event_type", F.lit("total")).alias("state"), "n", "large", "is_complete")


@query(f"""{_CANON},
ix AS (SELECT v.vec_id AS id, count(*) AS chunks, count(*) FILTER (len(embedding) = 64) AS vectors FROM embeddings v GROUP BY 1),
e AS (SELECT source, canon.doc_id, canonical_id, ix.id IS NOT NULL AS indexed, coalesce(l.quality = 0, false) AS outdated FROM canon LEFT JOIN ix ON ix.id = canonical_id LEFT JOIN labels l ON l.doc_id = canon.doc_id),
a AS (SELECT source, count(*)::bigint AS extracted, count(*) FILTER (indexed)::bigint AS indexed, count(*) FILTER (NOT indexed)::bigint AS missing, count(*) FILTER (indexed AND outdated)::bigint AS outdated, count(*) FILTER (canonical_id <> doc_id)::bigint AS merged FROM e GROUP BY source),
c AS (SELECT source, sum(chunks)::bigint AS chunks, sum(vectors)::bigint AS vectors FROM (SELECT DISTINCT source, canonical_id FROM e) JOIN ix ON ix.id = canonical_id GROUP BY source)
SELECT a.*, coalesce(chunks, 0)::bigint AS chunks, coalesce(vectors, 0)::bigint AS vectors FROM a LEFT JOIN c USING (source)""")
def q_index_status(spark: SparkSession, d: str) -> DataFrame:
    """Completeness of the index by source; a document's passages count once in a source."""
    ix = table(spark, d, "embeddings").groupBy(F.col("vec_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.size("embedding") == 64).alias("vectors"))
    e = _canonical(spark, d).join(ix, F.col("id") == F.col("canonical_id"), "left").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    indexed = F.col("id").isNotNull()
    counts = e.groupBy("source").agg(
        F.count(F.lit(1)).alias("extracted"),
        F.count_if(indexed).alias("indexed"),
        F.count_if(~indexed).alias("missing"),
        F.count_if(indexed & (F.col("quality") == 0)).alias("outdated"),
        F.count_if(F.col("canonical_id") != F.col("doc_id")).alias("merged"),
    )
    once = e.where(indexed).select("source", "canonical_id", "chunks", "vectors").distinct().groupBy("source").agg(F.sum("chunks").alias("chunks"), F.sum("vectors").alias("vectors"))
    return counts.join(once, "source", "left").fillna(0, ["chunks", "vectors"])


@query("SELECT vec_id AS id, 'vectors' AS kind FROM embeddings v WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = v.vec_id) UNION ALL SELECT doc_id, 'labels' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM embeddings v WHERE v.vec_id = l.doc_id)")
def q_stale_anti(spark: SparkSession, d: str) -> DataFrame:
    """Rows of either table without a counterpart in the other."""
    v, lab = table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return v.join(lab, "id", "left_anti").withColumn("kind", F.lit("vectors")).unionByName(lab.join(v, "id", "left_anti").withColumn("kind", F.lit("labels")))


@query("""SELECT coalesce(n.doc_id, o.vec_id) AS id, n.source, o.label::bigint AS label, n.doc_id IS NOT NULL AS listed,
CASE WHEN o.vec_id IS NULL THEN 'Pending' WHEN n.doc_id IS NULL THEN 'Unlisted' ELSE 'Kept' END AS state FROM documents n FULL JOIN embeddings o ON n.doc_id = o.vec_id""")
def q_manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    """A new listing against the manifest: matched kept, new pending, the rest unlisted."""
    n, o = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "embeddings").select("vec_id", "label")
    state = F.when(F.col("vec_id").isNull(), "Pending").when(F.col("doc_id").isNull(), "Unlisted").otherwise("Kept")
    return n.join(o, F.col("doc_id") == F.col("vec_id"), "full_outer").select(F.coalesce("doc_id", "vec_id").alias("id"), "source", F.col("label").cast("long").alias("label"), F.col("doc_id").isNotNull().alias("listed"), state.alias("state"))


@query("""SELECT n.doc_id, n.quality::bigint AS quality, n.toxic::bigint AS toxic, CASE WHEN o.doc_id IS NULL THEN 'new' ELSE 'changed' END AS change FROM labels n LEFT JOIN (SELECT vec_id AS doc_id, label % 2 AS quality, 0 AS toxic FROM embeddings) o ON n.doc_id = o.doc_id
WHERE o.doc_id IS NULL OR n.quality IS DISTINCT FROM o.quality OR n.toxic IS DISTINCT FROM o.toxic""")
def q_listing_diff(spark: SparkSession, d: str) -> DataFrame:
    """Labels that are new or differ from an older state of them."""
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("label") % 2).alias("quality"), F.lit(0).alias("toxic"))
    out = C.changed(table(spark, d, "labels"), old, "doc_id", ("quality", "toxic"))
    return out.select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"), "change")


@query("SELECT user_id, arg_max(event_type, row(ts, event_id)) AS state, count(*)::bigint AS n FROM events GROUP BY user_id")
def q_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each user."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("n"))


@query("""WITH i AS (SELECT user_id, ts, event_type, sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events WHERE event_type IN ('click', 'view', 'error'))
SELECT user_id, min(ts)::varchar AS first_at, max(ts)::varchar AS last_at, count(*)::bigint AS n FROM i WHERE event_type = 'click' GROUP BY user_id, g HAVING count(*) >= 3""")
def q_failure_streak(spark: SparkSession, d: str) -> DataFrame:
    """Three or more clicks in a row of a user's clicks, views and errors."""
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view", "error"))
    out = C.islands(e, ("user_id",), ("ts", "event_id"), F.col("event_type") == "click", 3)
    return out.select("user_id", *(_stamp(c) for c in ("first_at", "last_at")), "n")


def _stamp(c: str) -> F.Column:
    """A timestamp as digits: no trailing fraction, as in the checking SQL's text form."""
    return F.col(c).cast("string").alias(c)


@query("""SELECT user_id, event_id, round(epoch(ts) - epoch(lag(ts) OVER w), 3) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
QUALIFY gap < 600""")
def q_request_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Events less than ten minutes after the user's one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, d, "events").withColumn("gap", F.round(at - F.lag(at).over(w), 3))
    return e.where("gap < 600").select("user_id", "event_id", "gap")


@query("""WITH r AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS n FROM events)
SELECT event_type, user_id, event_id, n::bigint AS n FROM r WHERE n <= 250""")
def q_budget_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """The requests of each kind that a budget of 250 admits."""
    w = Window.partitionBy("event_type").orderBy("user_id", "event_id")
    return table(spark, d, "events").withColumn("n", F.row_number().over(w).cast("long")).where("n <= 250").select("event_type", "user_id", "event_id", "n")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS largest, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def q_latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles."""
    e = table(spark, d, "events")
    rest = e.groupBy("event_type").agg(F.max("value").alias("largest"), F.round(F.avg("value"), 6).alias("mean"))
    return nearest_rank(e, "event_type", "value", {"p50": 0.5, "p95": 0.95}).join(rest, "event_type")


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM events, unnest(json_keys(props)) AS t(k)")
def q_json_props(spark: SparkSession, d: str) -> DataFrame:
    """Every top-level property of every event."""
    e = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return e.select("event_id", "v", "k")


@query("""WITH i AS (SELECT user_id, epoch(ts)::bigint AS s, epoch(ts)::bigint + (value * 60)::bigint AS e FROM events),
p AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM i),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT user_id, min(s) AS s, max(e) AS e, count(*)::bigint AS n FROM g GROUP BY user_id, g""")
def q_highlight_merge(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of each user merged where they overlap or touch."""
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)  # halves to even, as in SQL
    i = table(spark, d, "events").select("user_id", at.cast("long").alias("s"), (at + F.rint(F.col("value") * 60)).cast("long").alias("e"))
    return C.merged_intervals(i, ("user_id",), "s", "e")

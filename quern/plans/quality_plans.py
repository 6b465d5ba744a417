"""Evaluation of retrieval and checks of question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import evaluation as E
from quern.operators import search as S
from quern.plans.registry import query
from quern.plans.retrieval import VECTOR_CTE, _vectors
from quern.sources.tables import table


@query(f"""WITH {VECTOR_CTE.replace(' AND a.label = b.label', '')},
r AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM vec), r50 AS (SELECT * FROM r WHERE rank <= 50),
want AS (SELECT a.vec_id AS q, b.vec_id AS doc FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
h AS (SELECT q, min(rank) AS first_rank, count(*) FILTER (rank <= 10) AS found FROM r50 JOIN want USING (q, doc) GROUP BY q),
o AS (SELECT q, wanted, first_rank, coalesce(found, 0) AS found FROM (SELECT q, count(*) AS wanted FROM want GROUP BY q) LEFT JOIN h USING (q))
SELECT round(avg(CASE WHEN first_rank <= 10 THEN 1.0::double ELSE 0 END), 6) AS recall, round(avg(CASE WHEN first_rank <= 10 THEN 1.0::double / first_rank ELSE 0 END), 6) AS mrr,
round(avg(found::double / least(wanted, 10)), 6) AS coverage, count(*) FILTER (first_rank <= 10)::bigint AS answered, count(*)::bigint AS questions FROM o""")
def q_eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every vector asks for those of its label; lists of 50, metrics at 10."""
    ranked = S.vector_topk(*_vectors(spark, d), 50)
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"))
    return E.metrics(E.outcomes_by_class(ranked.select("q", "doc", "rank"), items))


@query("SELECT label::bigint AS label, array_to_string(list_sort(list(vec_id)), ',') AS unknown FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id) GROUP BY label")
def q_eval_unknown_ids(spark: SparkSession, d: str) -> DataFrame:
    """Expected ids of each class that the labels do not know."""
    asked = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("vec_id").alias("doc_id"))
    lost = asked.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return lost.groupBy("label").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("unknown"))


_QUESTIONS_SQL = """q AS (SELECT conv_id::varchar AS id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS question, string_split(lower(text), ' ')[1:3] AS expected FROM conversations WHERE role = 'user')"""


@query(f"""WITH {_QUESTIONS_SQL},
v AS (SELECT id, 'no id' AS rule FROM q WHERE trim(coalesce(id, '')) = ''
UNION ALL SELECT id, 'no question' FROM q WHERE trim(coalesce(question, '')) = ''
UNION ALL SELECT id, 'question too long' FROM q WHERE length(question) > 500
UNION ALL SELECT id, 'expected is no list' FROM q WHERE expected IS NULL
UNION ALL SELECT id, 'nothing expected' FROM q WHERE len(expected) = 0
UNION ALL SELECT id, 'empty expected id' FROM q WHERE len(list_filter(expected, lambda e: trim(e) = '')) > 0
UNION ALL SELECT id, 'expected id twice' FROM q WHERE len(list_distinct(list_transform(expected, lambda e: trim(e)))) < len(expected)
UNION ALL SELECT id, 'id used twice' FROM q WHERE id IN (SELECT id FROM q GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT id, 'question used twice' FROM q WHERE question IN (SELECT question FROM q GROUP BY question HAVING count(*) > 1))
SELECT id, rule, count(*)::bigint AS n FROM v GROUP BY ALL""")
def q_question_set_violations(spark: SparkSession, d: str) -> DataFrame:
    """User turns as a question set: the rules that they break."""
    turns = table(spark, d, "conversations").where("role = 'user'")
    q = turns.select(F.col("conv_id").cast("string").alias("id"), F.col("text").alias("question"), F.slice(F.split(F.lower("text"), " "), 1, 3).alias("expected"))
    return E.violations(q).groupBy("id", "rule").agg(F.count(F.lit(1)).alias("n"))


#: Questions of a set that is hashed as one text; a longer set is an error.
MOST_QUESTIONS = 100_000


@query("SELECT sha256(string_agg(item_id || chr(31) || text, chr(10) ORDER BY item_id)) AS set_hash, count(*)::bigint AS n FROM benchmark")
def q_question_set_hash(spark: SparkSession, d: str) -> DataFrame:
    """One hash of the question set, in the order of ids; its definition is over one text, so its size is checked first."""
    asked = table(spark, d, "benchmark")
    if asked.count() > MOST_QUESTIONS:
        raise ValueError(f"more than {MOST_QUESTIONS} questions")
    rows = F.array_sort(F.collect_list(F.struct("item_id", "text")))
    joined = F.array_join(F.transform(rows, lambda x: F.concat_ws("\x1f", x["item_id"].cast("string"), x["text"])), "\n")
    return asked.agg(F.sha2(joined, 256).alias("set_hash"), F.count(F.lit(1)).alias("n"))


#: Question sets made of each user turn; what is no text, no list or no object stands in some of them.
_SETS_SQL = """s AS (SELECT conv_id * 1000 + turn AS source, text, conv_id % 9 AS k FROM conversations WHERE role = 'user')"""
_ITEM = {0: '{"id": 7, "question": "q", "expected": ["a"]}', 1: '{"id": "a", "question": null, "expected": ["a"]}', 2: '{"id": "a", "question": "q", "expected": "a"}', 3: '{"id": "a", "question": "q", "expected": ["a", 1]}', 4: '"text"'}
_RULE = {0: "id is no text", 1: "question is no text", 2: "expected is no list", 3: "expected id is no text", 4: "is not an object"}


@query(f"""WITH {_SETS_SQL} SELECT source, CASE WHEN k <= 4 THEN 2 ELSE 0 END AS "at", CASE k {" ".join(f"WHEN {k} THEN '{r}'" for k, r in _RULE.items())}
WHEN 5 THEN 'not valid JSON' WHEN 6 THEN 'no questions array' ELSE 'the question list is empty' END AS rule FROM s WHERE k < 8""")
def q_question_set_parse(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the form of question sets: one for each user turn, some of them malformed, with the turn as a question."""
    turns = table(spark, d, "conversations").where("role = 'user'").withColumn("k", F.col("conv_id") % 9)
    good = F.to_json(F.struct(F.lit("x").alias("id"), F.coalesce("text", F.lit("")).alias("question"), F.array(F.lit("a")).alias("expected")))
    second = F.coalesce(*(F.when(F.col("k") == k, F.lit(v)) for k, v in _ITEM.items()), good)
    whole = F.concat(F.lit('{"questions": ['), good, F.lit(", "), second, F.lit("]}"))
    json = F.when(F.col("k") == 5, F.substr(whole, F.lit(1), F.length(whole) - 1)).when(F.col("k") == 6, F.concat(F.lit('{"items": ['), good, F.lit("]}"))).when(F.col("k") == 7, '{"questions": []}').otherwise(whole)
    return E.parse_violations(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("source"), json.alias("json")))


@query("""WITH q AS (SELECT lang AS article, doc_id, string_split(lower(text), ' ')[1:4] AS expected FROM documents)
SELECT article, count(*)::bigint AS questions, (SELECT count(DISTINCT e) FROM (SELECT unnest(expected) AS e, article AS a FROM q) WHERE a = article)::bigint AS rulings FROM q GROUP BY article""")
def q_coverage_table(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a question that expects its first words: questions and different expectations of each language."""
    q = table(spark, d, "documents").select(F.col("lang").alias("article"), F.slice(F.split(F.lower("text"), " "), 1, 4).alias("expected"))
    return E.coverage_table(q)


@query("""WITH r AS (SELECT event_id AS ord, event_type || ' ' || (user_id % 5) AS config, CASE WHEN user_id % 3 = 0 THEN 'named ' || event_id ELSE ' ' END AS label FROM events),
k AS (SELECT config, min(ord) AS first, max(ord) AS ord, max_by(label, ord) AS label FROM r GROUP BY config)
SELECT ord AS "at", config, coalesce(nullif(trim(label), ''), 'iteration ' || (row_number() OVER (ORDER BY first, config) - 1)) AS label FROM k""")
def q_eval_history(spark: SparkSession, d: str) -> DataFrame:
    """Events as evaluation runs: the latest of each configuration in the place of its first, with default labels."""
    label = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("named "), F.col("event_id").cast("string"))).otherwise(F.lit(" "))
    runs = table(spark, d, "events").select(F.col("event_id").alias("at"), F.concat("event_type", F.lit(" "), (F.col("user_id") % 5).cast("string")).alias("config"), label.alias("label"))
    return E.history(runs)

"""Retrieval metrics over ranked lists and expected answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X


def outcomes(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(q, first_rank, found, wanted) for every question in ``expected``(q, doc); ``ranked``: (q, doc, rank)."""
    hits = ranked.join(expected, ["q", "doc"]).groupBy("q").agg(F.min("rank").alias("first_rank"), F.count_if(F.col("rank") <= k).alias("found"))
    return expected.groupBy("q").agg(F.countDistinct("doc").alias("wanted")).join(hits, "q", "left").fillna(0, ["found"])


def outcomes_by_class(ranked: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """As :func:`outcomes` where an item expects the others of its class: from the class sizes and the classes of ranked rows, without the pairs.

    ``ranked``: (q, doc, rank), ``items``: (id, class), one row an item.
    """
    size = items.groupBy("class").agg((F.count(F.lit(1)) - 1).alias("wanted"))
    asked = items.join(size, "class").where("wanted > 0").select(F.col("id").alias("q"), F.col("class").alias("own"), "wanted")
    other = items.select(F.col("id").alias("doc"), F.col("class").alias("theirs"))
    hits = ranked.where("q <> doc").join(asked, "q").join(other, "doc").where("own = theirs")
    counted = hits.groupBy("q").agg(F.min("rank").alias("first_rank"), F.count_if(F.col("rank") <= k).alias("found"))
    return asked.select("q", "wanted").join(counted, "q", "left").fillna(0, ["found"])


def metrics(outcome: DataFrame, k: int = 10) -> DataFrame:
    """Hit rate, mean reciprocal rank and coverage at ``k``, questions answered and asked."""
    hit = F.coalesce(F.col("first_rank") <= k, F.lit(False))
    reciprocal = F.when(hit, 1.0 / F.col("first_rank")).otherwise(0.0)
    coverage = F.col("found") / F.least("wanted", F.lit(k))
    return outcome.agg(
        F.round(F.avg(hit.cast("double")), 6).alias("recall"),
        F.round(F.avg(reciprocal), 6).alias("mrr"),
        F.round(F.avg(coverage), 6).alias("coverage"),
        F.count_if(hit).alias("answered"),
        F.count(F.lit(1)).alias("questions"),
    )


def violations(questions: DataFrame, longest: int = 500) -> DataFrame:
    """(id, rule) for each rule that a row of questions(id, question, expected) breaks.

    White space around ids and texts does not count. One pass finds what a row alone shows;
    ids and texts that occur twice are counted.
    """
    questions = questions.withColumns({c: X.strip(F.col(c)) for c in ("id", "question")})
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bare = F.transform("expected", lambda e: F.trim(e))
    rules = {
        "no id": blank("id"),
        "no question": blank("question"),
        "question too long": F.length("question") > longest,
        "expected is no list": F.col("expected").isNull(),
        "nothing expected": F.size("expected") == 0,
        "empty expected id": F.exists("expected", lambda e: F.coalesce(F.trim(e), F.lit("")) == ""),
        "expected id twice": F.size(F.array_distinct(bare)) < F.size("expected"),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items())))
    out = questions.select("id", F.explode(broken).alias("rule"))
    for column, rule in (("id", "id used twice"), ("question", "question used twice")):
        many = questions.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(column)
        out = out.unionByName(questions.join(many, column, "left_semi").select("id", F.lit(rule).alias("rule")))
    return out


def parse_violations(sets: DataFrame) -> DataFrame:
    """(source, at, rule) for sets(source, json) as they are read: what is no question set at all, and items that are none.

    ``at`` numbers questions from 1; 0 stands for the whole set.
    """
    whole = sets.select("source", F.try_parse_json("json").alias("v"))
    items = whole.select("source", "v", F.try_variant_get("v", "$.questions", "array<variant>").alias("items"))
    rule = F.when(F.col("v").isNull(), "not valid JSON").when(F.col("items").isNull(), "no questions array").when(F.size("items") == 0, "the question list is empty")
    of_set = items.select("source", F.lit(0).alias("at"), rule.alias("rule")).where("rule IS NOT NULL")
    each = items.select("source", F.posexplode("items").alias("p", "q")).withColumn("at", F.col("p") + 1)
    is_text = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("q", path, "variant")) == "STRING", F.lit(False))
    expected = F.try_variant_get("q", "$.expected", "array<variant>")
    rules = {
        "is not an object": ~F.coalesce(F.startswith(F.schema_of_variant("q"), F.lit("OBJECT")), F.lit(False)),
        "id is no text": ~is_text("$.id"),
        "question is no text": ~is_text("$.question"),
        "expected is no list": expected.isNull(),
        "expected id is no text": F.exists(expected, lambda e: F.coalesce(F.schema_of_variant(e) != "STRING", F.lit(True))),
    }
    first = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()))
    return of_set.unionByName(each.select("source", "at", first.alias("rule")).where("rule IS NOT NULL"))


def history(runs: DataFrame) -> DataFrame:
    """runs(at, config, label, ...) with a run for each configuration, the latest, in the place of the first; a run without label is "iteration N".

    N counts places from 0. Runs are few: one for each time a set was evaluated.
    """
    rest = [c for c in runs.columns if c != "config"]
    kept = runs.groupBy("config").agg(F.min("at").alias("_first"), F.max_by(F.struct(*rest), "at").alias("_r")).select("config", "_first", "_r.*")
    place = F.row_number().over(Window.orderBy("_first", "config")) - 1
    return kept.withColumn("label", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.concat(F.lit("iteration "), place.cast("string")))).drop("_first").select(*runs.columns)


def coverage_table(questions: DataFrame) -> DataFrame:
    """(article, questions, rulings): how many questions an article has and how many different documents they expect."""
    n = questions.groupBy("article").agg(F.count(F.lit(1)).alias("questions"))
    wanted = questions.select("article", F.explode("expected").alias("e")).groupBy("article").agg(F.countDistinct("e").alias("rulings"))
    return n.join(wanted, "article", "left").fillna(0, ["rulings"])

"""The data side of a crawl: states, budgets, retries, fallbacks, and what an index is to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import scan

#: States of an entry, and the ones that a run takes up again.
PENDING, DOWNLOADED, EXTRACTED, SKIPPED, FAILED = "Pending", "Downloaded", "Extracted", "ScannedSkipped", "Failed"

#: (state, what happened) to the next state; what is not here changes nothing.
STEPS = {
    (PENDING, "fetched"): DOWNLOADED,
    (PENDING, "error"): FAILED,
    (DOWNLOADED, "text"): EXTRACTED,
    (DOWNLOADED, "no text"): SKIPPED,
    (DOWNLOADED, "error"): FAILED,
    (FAILED, "retry"): PENDING,
    (EXTRACTED, "again"): DOWNLOADED,
    (SKIPPED, "again"): DOWNLOADED,
}
STATES = (PENDING, DOWNLOADED, EXTRACTED, SKIPPED, FAILED)


def follow(state: str, happened: list[str]) -> str:
    """The state after some happenings, in order."""
    for h in happened:
        state = STEPS.get((state, h), state)
    return state


def wanted(entries: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Entries that a run takes up: pending and downloaded ones, failed ones if they are to be tried again."""
    return entries.where(F.col("state").isin(PENDING, DOWNLOADED, *((FAILED,) if retry_failed else ())))


def indexable(entries: DataFrame) -> DataFrame:
    """Entries that are listed and have text."""
    return entries.where(F.col("listed") & (F.col("state") == EXTRACTED))


def is_pdf(content: Column) -> Column:
    """Whether bytes begin as a PDF does."""
    return F.coalesce(F.startswith(content, F.lit(b"%PDF-")), F.lit(False))


def backoff(attempt: Column, first: float, most: float) -> Column:
    """Seconds to wait before an attempt (from 0): doubling, at most ``most``."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), attempt), F.lit(most))


def spacing(requests: DataFrame, key: str, start: str, end: str, least: float, ranges: int | None = None) -> DataFrame:
    """Requests that begin less than ``least`` seconds after the end of their key's one before, with that ``gap``; times in seconds."""
    followed = scan.running(requests, (key,), (start, end), ranges, _ended=scan.previous(end))
    return followed.withColumn("gap", F.col(start) - F.col("_ended")).where(F.col("gap") < least).drop("_ended")


def within_budget(items: DataFrame, group: str, order: tuple[str, ...], size: str, budget: float, ranges: int | None = None) -> DataFrame:
    """Items in the order of (group, order) before the running sum of sizes first passes ``budget``, with that sum as ``used``.

    The sum runs over ranges of all items, so a group of any size is dealt over them.
    """
    return scan.running(items, (), (group, *order), ranges, used=scan.total(size)).where(F.col("used") <= budget)


def newest_or_cached(new: DataFrame, cached: DataFrame, key: str, body: str) -> DataFrame:
    """(key, body, from_cache): the new answer of each key, or the cached one where there is none."""
    n, c = new.select(key, F.col(body).alias("_new")), cached.select(key, F.col(body).alias("_old"))
    both = n.join(c, key, "full_outer").where("_new IS NOT NULL OR _old IS NOT NULL")
    return both.select(key, F.coalesce("_new", "_old").alias(body), F.col("_new").isNull().alias("from_cache"))


def plan(rulings: DataFrame, states: DataFrame, listings: DataFrame, selected: tuple[str, ...] | None = None) -> DataFrame:
    """(id, action) for rulings(id, chunk_key) against states(id, chunk_key, chunks, vectors): index, current, left or remove.

    Removal looks at everything; only rulings listed(id, library) in a ``selected`` library
    are indexed now (all if None), the other stale ones are left for later.
    """
    s = states.select("id", F.struct("chunk_key", "chunks", "vectors").alias("s"))
    r = rulings.select("id", F.col("chunk_key").alias("want"), F.lit(True).alias("held"))
    joined = r.join(s, "id", "full_outer")
    current = F.col("s").isNotNull() & (F.col("s.chunk_key") == F.col("want")) & (F.col("s.chunks") > 0) & (F.col("s.vectors") == F.col("s.chunks"))
    if selected is None:
        chosen = joined.withColumn("now", F.lit(True))
    else:
        of = listings.where(F.lower("library").isin(*(x.lower() for x in selected))).select("id").distinct().withColumn("now", F.lit(True))
        chosen = joined.join(of, "id", "left")
    action = F.when(F.col("held").isNull(), "remove").when(F.coalesce(current, F.lit(False)), "current").when(F.coalesce("now", F.lit(False)), "index").otherwise("left")
    return chosen.select("id", action.alias("action"))


def facet_options(facets: DataFrame, chosen: DataFrame) -> DataFrame:
    """(value, n) of facets(value, n) and of chosen(value) that the facets lack, with no number."""
    return facets.join(chosen.select("value").distinct(), "value", "full_outer")


class DuplicateId(ValueError):
    """An id occurs twice where it must not."""


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` as it is, or an error that names some keys that occur more than once."""
    many = [r[0] for r in df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key).limit(5).collect()]
    if many:
        raise DuplicateId(f"{key} occurs more than once: {many}")
    return df


def allowed_by_listing(listings: DataFrame, library: str | None, article: str | None = None) -> DataFrame:
    """(doc): documents listed in a library, under an article of it if given; case is ignored. An article needs a library."""
    if article is not None and library is None:
        raise ValueError("an article needs a library")
    kept = listings
    for column, value in (("library", library), ("article", article)):
        if value is not None:
            kept = kept.where(F.lower(column) == value.lower())
    return kept.select("doc").distinct()

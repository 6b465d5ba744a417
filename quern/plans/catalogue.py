"""All queries of the library with their SQL."""

from __future__ import annotations

from quern.plans import crawl_plans, landing_plans, listing_plans, passage_plans, quality_plans, retrieval, scale, sql_plans, state, structure  # noqa: F401 - they register queries
from quern.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

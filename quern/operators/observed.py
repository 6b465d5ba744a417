"""Counters that a job keeps while it runs: how many rows were read, rejected and written, from one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``df`` as it is, and the counters of the rows that pass when it is written; ``rows`` is always among them."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in counters.items())), seen


def rejects(reason: str, kinds: dict[str, str]) -> dict[str, Column]:
    """A counter for each kind of reason, by how it begins, and one of accepted rows."""
    return {"accepted": F.count_if(F.col(reason).isNull())} | {k: F.count_if(F.coalesce(F.col(reason).startswith(start), F.lit(False))) for k, start in kinds.items()}


def as_rows(df: DataFrame, *seen: Observation) -> DataFrame:
    """(stage, counter, n) of observations whose jobs have run."""
    rows = [(o._name, k, int(v)) for o in seen for k, v in o.get.items()]  # a few numbers each
    return df.sparkSession.createDataFrame(rows, "stage string, counter string, n long")

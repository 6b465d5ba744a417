"""Joins, rankings, aggregations and diffs over DataFrames."""

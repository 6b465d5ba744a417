"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        where = path if os.path.isfile(path) else f"{path}/*.parquet"
        if glob.glob(where):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def difference(df, sf_dir: str, sql: str) -> str:
    """What differs, or an empty string."""
    names, rows = sql_rows(sf_dir, sql)
    mine = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = [names.index(c) for c in df.columns]
    a = sorted(tuple(normal(v) for v in r) for r in mine)
    b = sorted(tuple(normal(r[i]) for i in order) for r in rows)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows, such as {wrong[:2]}" if wrong else ""

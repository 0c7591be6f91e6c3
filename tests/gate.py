"""Correctness gate helpers: run a query in Spark and its oracle in DuckDB on
the same parquet tables and compare column names, row count and values
(order-insensitive)."""

from __future__ import annotations

import math

from pagemill.schemas import SUPPLIED


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def canonical(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in SUPPLIED:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir: str, fn, sql: str | None):
    """Returns (ok, message)."""
    df = fn(spark, sf_dir)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"{len(s_rows)} rows (no oracle)"
    r = con.execute(sql)
    d_cols, d_rows = [c[0] for c in r.description], r.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns spark={s_cols} duck={d_cols}"
    a, b = canonical(s_cols, s_rows), canonical(d_cols, d_rows)
    if a == b:
        return True, f"{len(a)} rows"
    sb, sa = set(b), set(a)
    return False, (f"spark {len(a)} rows, duck {len(b)} rows; spark-only {repr([x for x in a if x not in sb][:2])[:800]}; "
                   f"duck-only {repr([x for x in b if x not in sa][:2])[:800]}")

"""Run a registered query and its DuckDB text over the same tables and compare every row."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(v, digits=None):
    """A comparable form; ``digits`` significant digits of a double count, all of them by default."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v if digits is None else float(f"{v:.{digits}g}") + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return {k: canonical(x, digits) for k, x in sorted(v.items())}
    if hasattr(v, "asDict"):
        return [canonical(x, digits) for x in v]
    if isinstance(v, (list, tuple)):
        return [canonical(x, digits) for x in v]
    return v


def rows_of(columns, rows, digits=None):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([canonical(r[i], digits) for i in order]) for r in rows)


def compare(spark, con, sf_dir, name, queries, oracles, digits=None):
    """Empty string when equal, else a short description of the difference."""
    df = queries[name](spark, sf_dir)
    got = df.collect()
    if name not in oracles:
        return "" if got else "no rows"
    cur = con.execute(oracles[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got, digits), rows_of(cols, want, digits)
    if not a:
        return "no rows"
    if a == b:
        return ""
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    n = len(set(a) - set(b))
    return f"rows {len(a)} vs {len(b)}, {n} differ\n   cols {sorted(cols)}\n   spark {only_a}\n   duck  {only_b}"

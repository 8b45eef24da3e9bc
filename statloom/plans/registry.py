"""Named queries: a Spark callable and, where SQL can say it, the DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; doubles are rounded on the way out."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double so that the order of a distributed sum cannot show."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def show(body: str, keys: str = "", doubles: str = "", ctes: str = "", money: str = "") -> str:
    """Oracle text: ``keys`` pass through, ``doubles`` are rounded to 6 places and ``money`` to 2, like the Spark side."""
    body, ctes, keys = _quoted(body), _quoted(ctes), _quoted(keys)
    columns = [c.strip() for c in keys.split(",") if c.strip()]
    columns += [f"round({c.strip()}, 6) + 0.0 AS {c.strip()}" for c in doubles.split(",") if c.strip()]
    columns += [f"round({c.strip()}, 2) + 0.0 AS {c.strip()}" for c in money.split(",") if c.strip()]
    head = f"WITH {ctes.strip().rstrip(',')} " if ctes.strip() else ""
    return f"{head}SELECT {', '.join(columns)} FROM ({body.strip()}) AS result_rows"


def _quoted(sql: str) -> str:
    """``at`` is a reserved word in the oracle's dialect."""
    return re.sub(r'(?<![\w".])at(?![\w"])', '"at"', sql)


def to_cents(df: DataFrame, *names: str) -> DataFrame:
    """Large money columns rounded to cents, the finest step a double of that size carries safely."""
    return df.withColumns({n: F.round(n, 2) for n in names})

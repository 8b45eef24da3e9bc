"""Checks in flight: a table is measured while it is written, and a write that fails a check leaves nothing behind.

Measures are aggregates Spark collects during the one pass that writes (or reads)
the rows (``Dataset.observe``), so no check costs a scan of its own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from statloom.operators.compare import require_columns, strip_columns
from statloom.sources.vintage_store import _place, removed

LOG = "check_name string, measured double, low double, high double, ok boolean"


class CheckFailed(ValueError):
    """A checked write was refused; ``log`` holds the measured checks."""

    def __init__(self, log: list[tuple]):
        self.log = log
        super().__init__("; ".join(f"{name}: {measured} is not in [{low}, {high}]" for name, measured, low, high, ok in log if not ok))


@dataclass(frozen=True)
class Check:
    """An aggregate of the rows (not a distinct one) that must lie between two bounds; None is no bound."""

    name: str
    measure: Column
    low: float | None = None
    high: float | None = None

    def result(self, measured) -> tuple:
        value = None if measured is None else float(measured)
        ok = value is not None and (self.low is None or value >= self.low) and (self.high is None or value <= self.high)
        bounds = [None if b is None else float(b) for b in (self.low, self.high)]
        return self.name, value, *bounds, ok


def exactly(name: str, measure: Column, value: float, tolerance: float = 0.0) -> Check:
    return Check(name, measure, value - tolerance, value + tolerance)


def none_where(name: str, condition: Column) -> Check:
    """No row may meet the condition."""
    return Check(name, F.count_if(F.coalesce(condition, F.lit(False))), 0, 0)


def measured(df: DataFrame, checks: list[Check]) -> tuple[DataFrame, Observation]:
    """``df`` with its checks riding along; the observation is filled by the next action on it."""
    seen = Observation(f"checks-{uuid.uuid4().hex}")
    return df.observe(seen, *[c.measure.alias(f"c{i}") for i, c in enumerate(checks)]), seen


def results(checks: list[Check], seen: Observation) -> list[tuple]:
    values = seen.get
    return [c.result(values[f"c{i}"]) for i, c in enumerate(checks)]


def log_rows(spark: SparkSession, log: list[tuple]) -> DataFrame:
    """The validation log as a table."""
    return spark.createDataFrame(log, LOG)


def checked_write(df: DataFrame, path: str, checks: list[Check], required: list[str] | None = None, restricted: list[str] | None = None, refuse: bool = True) -> list[tuple]:
    """Write ``df`` as Parquet to the new folder ``path`` if it passes; the log of its checks.

    Columns are judged before any row is read: a required one that is missing, or a
    restricted one that is left, stops the write.  Rows go to a folder beside the
    target in the same pass that measures them, and take its name only if every
    check holds; otherwise they are deleted and ``CheckFailed`` is raised.  With
    ``refuse`` off a failed write is deleted too, but only the log tells of it.
    """
    spark = df.sparkSession
    files, target = _place(spark, path)
    if files.exists(target):
        raise FileExistsError(path)
    out = strip_columns(df, restricted) if restricted else df
    out = require_columns(out, required) if required else out
    rows, seen = measured(out, checks)
    staging = f"{path.rstrip('/')}.checking-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(staging)
        log = results(checks, seen)
        if all(ok for *_, ok in log):
            if not files.rename(_place(spark, staging)[1], target):
                raise FileExistsError(path)
        elif refuse:
            raise CheckFailed(log)
        return log
    finally:
        removed(spark, staging)


def column_report(tables: dict[str, DataFrame], required: dict[str, list[str]], spark: SparkSession) -> DataFrame:
    """One row for every required column of every table, and whether it is there; schemas only."""
    rows = [(name, column, column in tables[name].columns if name in tables else False) for name, wanted in sorted(required.items()) for column in wanted]
    return spark.createDataFrame(rows, "table_name string, column_name string, present boolean")


def partition_digests(df: DataFrame, partition: Column, columns: list[str]) -> DataFrame:
    """part, n_rows and digest of every partition: sums of row hashes, so any order of rows gives the same.

    A row is hashed over its columns with their borders and nulls marked; the sum of
    two 60-bit halves of its MD5 counts repeated rows, which an exclusive or would not.
    """
    fields = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    text = F.concat_ws("\x1f", *fields)
    code = F.md5(text.cast("binary"))

    def half(start: int) -> Column:
        return F.sum(F.conv(F.substring(code, start, 15), 16, 10).cast("decimal(38,0)")).cast("string")

    return df.groupBy(partition.alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", half(1), half(16)).alias("digest"))


def changed_partitions(current: DataFrame, stored: DataFrame) -> DataFrame:
    """part, n_rows, stored_rows and state (new, gone, changed or same) of two digests of a table."""
    old = stored.select(F.col("part").alias("_p"), F.col("n_rows").alias("stored_rows"), F.col("digest").alias("_d"))
    both = current.join(old, F.col("part").eqNullSafe(F.col("_p")), "full_outer")
    state = F.when(F.col("_d").isNull(), "new").when(F.col("digest").isNull(), "gone").when(F.col("digest") == F.col("_d"), "same").otherwise("changed")
    return both.select(F.coalesce("part", "_p").alias("part"), "n_rows", "stored_rows", state.alias("state"))


def table_fingerprint(digests: DataFrame) -> DataFrame:
    """One fingerprint of a whole table from those of its partitions, for ``compare.changed_sources``."""
    each = F.md5(F.concat_ws("|", F.coalesce(F.col("part").cast("string"), F.lit("")), "digest").cast("binary"))
    return digests.agg(F.sum(F.conv(F.substring(each, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("fingerprint"))

"""Outputs: partitioned files and nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.compare import strip_columns


def write_periods(df: DataFrame, folder: str, period: str = "period", restricted: list[str] | None = None) -> None:
    """CSV and parquet per period, after restricted columns are gone."""
    out = strip_columns(df, restricted) if restricted else df
    out.write.mode("overwrite").partitionBy(period).option("header", True).csv(f"{folder}/csv")
    out.write.mode("overwrite").partitionBy(period).parquet(f"{folder}/parquet")


def columnar_documents(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One JSON document per key with arrays aligned to the ordered axis; a key's series is bounded by its calendar."""
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("_s"))
    # a field of an array of structs is the array of that field
    arrays = [F.col(f"_s.{c}").alias(c) for c in [order, *columns]]
    return rows.select(key, F.to_json(F.struct(*arrays)).alias("document"))


def assembled(key: str, parts: dict[str, tuple[DataFrame, str, list[str], str]]) -> DataFrame:
    """One row per unit out of many tables, which meet in one shuffle on the unit.

    parts[name] = (table, order, columns, how): every table's rows become a struct
    (order first) in a column of their own of one union, and one grouping takes each
    column as its part says: ``series`` an array in order, ``last`` the struct of the
    largest order.  A unit that a table lacks gets an empty array or NULL there.  A
    unit's series is bounded by its calendar.
    """
    union = None
    for name, (table, order, columns, _) in parts.items():
        rows = table.select(key, F.struct(order, *[c for c in columns if c != order]).alias(name))
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    take = {"series": lambda c: F.sort_array(F.collect_list(c)), "last": F.max}
    return union.groupBy(key).agg(*[take[how](name).alias(name) for name, (_, _, _, how) in parts.items()])


def data_vintage(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Last year present per source."""
    out = None
    for name, (df, year) in sources.items():
        row = df.agg(F.max(year).alias("last_year")).select(F.lit(name).alias("source"), "last_year")
        out = row if out is None else out.unionByName(row)
    return out

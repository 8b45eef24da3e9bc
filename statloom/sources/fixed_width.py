"""Fixed-width government records.  Files come in through ``read_lines``; parsers work on a ``line`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators.ledger import EMPLOYMENT_CODES

# Length of the unit id before and after the change of format.
LEGACY_ID, CURRENT_ID = 14, 12


def read_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Whole lines of a Latin-1 file, split across tasks by the csv reader (a separator that never occurs)."""
    return spark.read.csv(path, schema="line string", sep="\u0001", quote="", encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def ledger_items(lines: DataFrame, id_length: int, unit_type: str = "2") -> DataFrame:
    """raw_id, code, amount (thousands) and flag of lines whose third character is the unit type."""
    raw = F.substring("line", 1, id_length)
    return lines.filter(F.substring("line", 3, 1) == unit_type).select(
        *[c for c in lines.columns if c != "line"],
        raw.alias("raw_id"),
        F.substring("line", id_length + 1, 3).alias("code"),
        F.trim(F.substring("line", id_length + 4, 12)).try_cast("bigint").alias("amount"),
        F.substring("line", id_length + 20, 1).alias("flag"),
    )


def bridge_eras(legacy: DataFrame, current: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Old ids become current ones through crosswalk(raw_id, unit); rows without one are left out."""
    old = legacy.join(crosswalk, "raw_id").drop("raw_id")
    new = current.withColumn("unit", F.substring("raw_id", 7, 6)).drop("raw_id")
    return old.unionByName(new.select(*old.columns))


def county_spending(lines: DataFrame, id_length: int) -> DataFrame:
    """Corrections, judicial and police dollars of county governments, keyed by state and county digits."""
    items = ledger_items(lines, id_length, "1")
    kind, fn = F.substring("code", 1, 1), F.substring("code", 2, 2)
    own = items.filter(kind.isin("E", "F", "G"))

    def dollars(*functions):
        return F.coalesce(F.sum(F.when(fn.isin(*functions), F.col("amount"))), F.lit(0)) * 1000

    place = F.concat(F.substring("raw_id", 1, 2), F.substring("raw_id", 4, 3))
    return own.groupBy(place.alias("county")).agg(dollars("04", "05").alias("corr"), dollars("25").alias("jud"), dollars("62").alias("pol"))


def employment_items(lines: DataFrame, crosswalk: DataFrame, from_year: int = 2021) -> DataFrame:
    """Staff counts and pay of 80-character lines: lines(year, line).

    The new id (last six positions, from 2021) is preferred to the crosswalk;
    ``disagrees`` marks rows where both exist and differ.
    """
    def number(start, length):
        text = F.trim(F.substring("line", start, length))
        return F.coalesce(text.try_cast("bigint"), F.lit(0))

    rows = lines.filter((F.substring("line", 3, 1) == "2") & F.substring("line", 18, 3).isin(*EMPLOYMENT_CODES)).select(
        "year",
        F.substring("line", 1, 14).alias("raw_id"),
        F.substring("line", 18, 3).alias("code"),
        number(21, 10).alias("ft"),
        F.substring("line", 32, 1).alias("ft_flag"),
        number(33, 12).alias("ft_pay"),
        F.when(F.col("year") >= from_year, F.nullif(F.trim(F.substring("line", 75, 6)), F.lit(""))).alias("_new"),
    )
    joined = rows.join(crosswalk.withColumnRenamed("unit", "_old"), "raw_id", "left")
    return joined.select(
        F.coalesce("_new", "_old").alias("unit"), "year", "code", "ft", "ft_flag", "ft_pay", F.coalesce(F.col("_new") != F.col("_old"), F.lit(False)).alias("disagrees")
    ).filter("unit IS NOT NULL")


def require_agreement(items: DataFrame) -> DataFrame:
    """Stop when any new and legacy id disagree; one count, no rows are brought back."""
    bad = items.filter("disagrees").count()
    if bad:
        raise ValueError(f"{bad} employment rows carry two different unit ids")
    return items.drop("disagrees")

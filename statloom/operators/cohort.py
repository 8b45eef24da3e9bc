"""Cohort residual tracing: expected counts from national survival ratios."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.ordered import top_k, with_group_totals

# The standard five-year bins and the finer published bands that fold into them.
STANDARD_BINS = [
    "0-4", "5-9", "10-14", "15-19", "20-24", "25-29", "30-34", "35-39", "40-44",
    "45-49", "50-54", "55-59", "60-64", "65-69", "70-74", "75-79", "80-84", "85+",
]
FINE_BANDS = {
    "15-17": "15-19", "18-19": "15-19", "20": "20-24", "21": "20-24", "22-24": "20-24",
    "60-61": "60-64", "62-64": "60-64", "65-66": "65-69", "67-69": "65-69",
}


def age_span(label: str) -> tuple[int, int | None] | None:
    """Lowest and highest age of a bin, None above for an open one; None for a label that is no span."""
    closed, opened = re.fullmatch(r"(\d+)-(\d+)", label), re.fullmatch(r"(\d+)\+", label)
    return (int(closed[1]), int(closed[2])) if closed else (int(opened[1]), None) if opened else None


def cohort_specs(bins0=None, bins1=None, years: int = 10) -> list[tuple[str, list[str], str]]:
    """(label, source bins, destination bin) of every cohort that can be followed for ``years``.

    Every closed bin's ages are moved up and sought in the narrowest destination
    that covers them.  Bins that end in the same destination are one cohort, kept
    if together they fill it: from its lowest age to its highest, or, for the open
    bin, as far as the people who were not in it before.
    """
    spans0, spans1 = ({b: s for b in (bins or STANDARD_BINS) if (s := age_span(b))} for bins in (bins0, bins1))
    closed = sorted((low, high, b) for b, (low, high) in spans0.items() if high is not None)
    finest = [x for x in closed if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in closed)]
    arriving: dict[str, list[tuple[int, int, str]]] = {}
    for low, high, band in finest:
        covers = [(top - base if top is not None else math.inf, target) for target, (base, top) in spans1.items() if base <= low + years and (top is None or high + years <= top)]
        if covers:
            arriving.setdefault(min(covers)[1], []).append((low, high, band))
    out = []
    for target, bands in arriving.items():
        base, top = spans1[target]
        ages = [age for low, high, _ in bands for age in range(low, high + 1)]
        if ages == list(range(base - years, base if top is None else top - years + 1)):
            out.append((f"{ages[0]}-{ages[-1]}", [band for _, _, band in bands], target))
    return out


def recode(df: DataFrame, column: str, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Replace values found in a code table; anything else passes through."""
    renamed = mapping.select(F.col(source).alias(column), F.col(target).alias("_to"))
    return df.join(renamed, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def apply_crosswalk(df: DataFrame, renames: DataFrame, groups: DataFrame) -> DataFrame:
    """Counties to constant-territory units: rename codes, then merge members into groups.

    renames(geoid, new_geoid); groups(geoid, group_id).  A merged unit is named
    by its group id, a single one keeps its own (smallest) name.
    """
    renamed = recode(df, "geoid", renames, "geoid", "new_geoid")
    mapped = renamed.join(groups, "geoid", "left")
    sums = [F.sum("count").alias("count")] + ([F.sum("gq_count").alias("gq_count")] if "gq_count" in df.columns else [])
    return (
        mapped.withColumn("unit", F.coalesce("group_id", "geoid"))
        .withColumn("name", F.coalesce("group_id", "name"))
        .groupBy("year", "unit", "sex", "age_bin")
        .agg(F.min("name").alias("name"), *sums)
    )


def splice_replace(df: DataFrame, replacement: DataFrame, year: int) -> DataFrame:
    """Drop the replacement's units in one year and append its rows instead."""
    keys = replacement.select("unit", F.lit(year).alias("year")).distinct()
    return df.join(keys, ["unit", "year"], "left_anti").unionByName(replacement.select(*df.columns))


def splice_top_bins(base: DataFrame, top: DataFrame, bins=("75-84", "85+"), by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Oldest bins taken from a second table.

    Returns the spliced rows and, per (unit, sex), a row of ``checks``: both
    sums, whether they differ and whether the second table lacks the unit.
    ``by`` names further keys, such as the year, that tell tables apart.
    """
    unit, cell = ["unit", *by], ["unit", "sex", *by]
    oldest = F.col("age_bin").isin(*bins)
    a = base.filter(oldest).groupBy(*cell).agg(F.sum("count").alias("base_sum"))
    b = top.filter(oldest).groupBy(*cell).agg(F.sum("count").alias("top_sum"))
    checks = a.join(b, cell, "left").select(
        *cell, "base_sum", "top_sum", (F.col("base_sum") != F.col("top_sum")).alias("mismatch"), F.col("top_sum").isNull().alias("missing")
    )
    kept = top.filter(oldest).join(base.select(*unit).distinct(), unit, "left_semi")
    return base.filter(~oldest).unionByName(kept.select(*base.columns)), checks


def trace(df: DataFrame, periods, specs=None, basis: str = "auto") -> DataFrame:
    """Residuals for every (period, unit, cohort, sex).

    df(year, unit, sex, age_bin, count[, gq_count]).  Both ends of all periods
    are summed in one aggregation keyed by the small fixed table of specs; the
    national ratio is an aggregate of that result.  ``basis`` 'auto' uses
    households (count minus group quarters, floored at 0) for periods where
    both ends publish group quarters.
    """
    spark = df.sparkSession
    specs = specs or cohort_specs()
    rows = [
        (f"{t0}-{t1}", year, end, band, label, _birth_years(label, t0))
        for t0, t1 in periods
        for label, sources, target in specs
        for end, year, bands in (("t0", t0, sources), ("t1", t1, [target]))
        for band in bands
    ]
    spec = spark.createDataFrame(rows, "period string, year int, end string, age_bin string, cohort_age_at_t0 string, birth_years string")
    ends = spark.createDataFrame([(f"{a}-{b}", y, e) for a, b in periods for e, y in (("t0", a), ("t1", b))], "period string, year int, end string")

    by_unit = df.groupBy("unit", "year").agg(*([F.sum("gq_count").alias("gq")] if "gq_count" in df.columns else [F.lit(0).alias("gq")]))
    common = (
        by_unit.join(F.broadcast(ends), "year")
        .groupBy("period", "unit")
        .agg(F.count_distinct("end").alias("_ends"))
        .filter("_ends = 2")
        .select("period", "unit")
    )
    gq_years = by_unit.groupBy("year").agg((F.sum("gq") > 0).alias("has_gq"))
    kinds = ends.join(gq_years, "year").groupBy("period").agg(F.every("has_gq").alias("_both"))
    if basis == "auto":
        kinds = kinds.select("period", F.when(F.col("_both"), "household").otherwise("total").alias("basis"))
    else:
        kinds = kinds.select("period", F.lit(basis).alias("basis"))

    total = F.col("count")
    house = F.greatest(F.col("count") - F.col("gq_count"), F.lit(0)) if "gq_count" in df.columns else total
    cells = (
        df.join(F.broadcast(spec), ["year", "age_bin"])
        .groupBy("period", "unit", "cohort_age_at_t0", "birth_years", "sex")
        .agg(
            *[
                F.sum(F.when(F.col("end") == e, v)).alias(f"{name}_{e}")
                for e in ("t0", "t1")
                for name, v in (("total", total), ("house", house))
            ]
        )
        .join(common, ["period", "unit"], "left_semi")
        .join(kinds, "period")
    )
    is_house = F.col("basis") == "household"
    cells = cells.select(
        "period",
        "basis",
        "unit",
        "cohort_age_at_t0",
        "birth_years",
        "sex",
        *[F.coalesce(F.when(is_house, F.col(f"house_{e}")).otherwise(F.col(f"total_{e}")), F.lit(0)).cast("double").alias(f"count_{e}") for e in ("t0", "t1")],
    )
    nation = with_group_totals(cells, ["period", "cohort_age_at_t0", "sex"], _n0=F.sum("count_t0"), _n1=F.sum("count_t1")).filter("_n0 > 0")
    ratio = F.col("_n1") / F.col("_n0")
    traced = nation.select(
        "period",
        "basis",
        "unit",
        "cohort_age_at_t0",
        "birth_years",
        "sex",
        "count_t0",
        "count_t1",
        ratio.alias("national_ratio"),
        (F.col("count_t0") * ratio).alias("expected_t1"),
        (F.col("count_t1") - F.col("count_t0") * ratio).alias("net_residual"),
    )
    return with_rate(traced).withColumn("reliability", F.when(F.col("expected_t1") < 100, "low").otherwise("ok"))


def consecutive_periods(df: DataFrame) -> list[tuple[int, int]]:
    """Every year there is with the next one; a year is one row here, whatever the table holds."""
    years = sorted(r[0] for r in df.select("year").distinct().collect() if r[0] is not None)
    return list(zip(years, years[1:]))


def _birth_years(label: str, t0: int) -> str:
    low, high = (int(x) for x in label.split("-"))
    return f"{t0 - high - 1}-{t0 - low}"


def with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("net_migration_rate", F.when(F.col("expected_t1") > 0, F.col("net_residual") / F.col("expected_t1")))


def dropped_units(df: DataFrame, periods) -> DataFrame:
    """Units seen at only one end of a period, with the end they are missing from."""
    ends = df.sparkSession.createDataFrame([(f"{a}-{b}", y, e) for a, b in periods for e, y in (("t0", a), ("t1", b))], "period string, year int, end string")
    seen = df.select("unit", "year").distinct().join(F.broadcast(ends), "year").groupBy("period", "unit").agg(F.min("end").alias("a"), F.max("end").alias("b"))
    return seen.filter("a = b").select("period", "unit", F.when(F.col("a") == "t0", "t1").otherwise("t0").alias("missing_end"))


def both_sexes(flows: DataFrame) -> DataFrame:
    sums = ["count_t0", "count_t1", "expected_t1", "net_residual"]
    return with_rate(flows.groupBy("period", "unit", "cohort_age_at_t0", "birth_years").agg(*[F.sum(c).alias(c) for c in sums]))


def young_adults(flows: DataFrame, names: DataFrame, k: int = 20, min_expected: float = 1000.0, cohorts=("10-14", "15-19")) -> DataFrame:
    """Highest and lowest k units by residual rate of the young cohorts, per period."""
    sums = ["expected_t1", "count_t1", "net_residual"]
    table = (
        flows.filter(F.col("cohort_age_at_t0").isin(*cohorts))
        .groupBy("period", "unit")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .filter(F.col("expected_t1") >= min_expected)
    )
    table = with_rate(table).join(names, "unit", "left")
    high = top_k(table, "period", [F.round("net_migration_rate", 9).desc(), F.col("unit")], k).withColumn("side", F.lit("top"))
    low = top_k(table, "period", [F.round("net_migration_rate", 9), F.col("unit")], k).withColumn("side", F.lit("bottom"))
    return high.unionByName(low)


def latest_names(df: DataFrame) -> DataFrame:
    return df.groupBy("unit").agg(F.max_by("name", "year").alias("name"))


def anchor_check(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """National totals against published ones: anchors(year, published, tolerance)."""
    totals = df.groupBy("year").agg(F.sum("count").alias("ours"))
    diff = F.col("ours") - F.col("published")
    return totals.join(anchors, "year").select("year", "ours", "published", diff.alias("diff"), (F.abs(diff) <= F.col("tolerance")).alias("ok"))


def pack(flows: DataFrame) -> DataFrame:
    """Per unit, period and sex: [expected, actual, expected, actual, ...] over the ordered cohorts, zeros where absent."""
    start = F.split("cohort_age_at_t0", "-")[0].cast("int")
    cohorts = flows.groupBy("period").agg(F.sort_array(F.collect_set(F.struct(start.alias("o"), F.col("cohort_age_at_t0").alias("c")))).alias("_all"))
    cells = flows.groupBy("unit", "period", "sex").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("cohort_age_at_t0"), F.array(F.round("expected_t1").cast("bigint"), F.col("count_t1").cast("bigint"))))
        ).alias("_have")
    )
    zeros = F.array(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    packed = F.flatten(F.transform("_all", lambda s: F.coalesce(F.try_element_at("_have", s["c"]), zeros)))
    return cells.join(cohorts, "period").select("unit", "period", "sex", packed.alias("pairs"))

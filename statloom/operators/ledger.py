"""Item ledgers of local governments: roll-ups, flags, deflation, allocation, staffing, crime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.calendar import calendar_lag
from statloom.functions.stats import half_even, pair_corr
from statloom.operators.ordered import exact_quantiles, with_one_row, with_position

# Item-code sets of the public finance classification.
EXPENDITURE = list("EFGIJLMQS")
DIRECT = list("EFGIJ")
OPERATIONS_AND_CAPITAL = list("EFG")
INTERGOVERNMENTAL = list("LMQS")
UTILITY_FUNCTIONS = ["90", "91", "92", "93", "94"]
EDUCATION_FUNCTIONS = ["09", "12", "16", "18", "21"]
COUNTY_LIKE_FUNCTIONS = ["04", "05", "36", "77", "79"]
HEALTH_FUNCTIONS = ["32"]
ENTERPRISE_FUNCTIONS = ["01", "87"]
POLICE, FIRE = "62", "24"
# Consolidated governments by name prefix and state; Virginia cities are all independent.
CONSOLIDATED = [
    ("ANCHORAGE", "AK"), ("ATHENS", "GA"), ("AUGUSTA", "GA"), ("BALTIMORE", "MD"), ("BATON ROUGE", "LA"), ("COLUMBUS", "GA"),
    ("DENVER", "CO"), ("HONOLULU", "HI"), ("INDIANAPOLIS", "IN"), ("JACKSONVILLE", "FL"), ("LAFAYETTE", "LA"), ("LEXINGTON", "KY"),
    ("LOUISVILLE", "KY"), ("MACON", "GA"), ("NASHVILLE", "TN"), ("NEW ORLEANS", "LA"), ("NEW YORK", "NY"), ("PHILADELPHIA", "PA"),
    ("SAN FRANCISCO", "CA"), ("ST LOUIS", "MO"), ("WASHINGTON", "DC"), ("WYANDOTTE", "KS"),
]
# Data flags that count as reported, and the prorated one.
REPORTED_FLAGS = list("RCKUVZ")
PRORATED_FLAG = "T"


def ledger_metrics(items: DataFrame, min_items: int = 30) -> DataFrame:
    """items(unit, year, code, amount in thousands, flag) to one wide row per unit and year.

    One aggregation with conditional sums: every metric is combined on the map side.
    """
    kind, fn = F.substring("code", 1, 1), F.substring("code", 2, 2)
    spent = kind.isin(*EXPENDITURE)
    general = spent & ~fn.isin(*UTILITY_FUNCTIONS)
    own = kind.isin(*OPERATIONS_AND_CAPITAL)
    between = kind.isin(*INTERGOVERNMENTAL)

    def dollars(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("amount"))), F.lit(0)) * 1000

    # a flag is one sign between blank and underscore: the signs seen are bits of one number, combined like a sum
    sign = F.ascii("flag") - 32

    def flags(condition: Column) -> Column:
        return F.bit_or(F.when(condition & (F.col("amount") != 0) & sign.between(0, 63), F.call_function("shiftleft", F.lit(1).cast("bigint"), sign)))

    def spelled(bits: str) -> Column:
        signs = F.array_join(F.filter(F.transform(F.sequence(F.lit(32), F.lit(95)), lambda c: F.when(F.getbit(F.col(bits), c - 32) == 1, F.char(c))), lambda x: x.isNotNull()), "")
        return F.when(F.col(bits).isNull() | (signs == ""), "-").otherwise(signs)

    measures = {
        "total_expenditure_usd": spent,
        "general_expenditure_usd": general,
        "direct_general_expenditure_usd": kind.isin(*DIRECT) & ~fn.isin(*UTILITY_FUNCTIONS),
        "education_usd": spent & fn.isin(*EDUCATION_FUNCTIONS),
        "county_like_functions_usd": spent & fn.isin(*COUNTY_LIKE_FUNCTIONS),
        "enterprise_usd": spent & fn.isin(*ENTERPRISE_FUNCTIONS),
        "health_usd": spent & fn.isin(*HEALTH_FUNCTIONS),
        "police_usd": own & (fn == POLICE),
        "police_current_ops_usd": F.col("code") == "E" + POLICE,
        "police_capital_usd": F.col("code").isin("F" + POLICE, "G" + POLICE),
        "police_intergov_usd": between & (fn == POLICE),
        "fire_usd": own & (fn == FIRE),
        "fire_current_ops_usd": F.col("code") == "E" + FIRE,
        "fire_capital_usd": F.col("code").isin("F" + FIRE, "G" + FIRE),
        "fire_intergov_usd": between & (fn == FIRE),
    }
    base = items.groupBy("unit", "year").agg(
        *[dollars(c).alias(name) for name, c in measures.items()],
        flags(own & (fn == POLICE)).alias("police_flags"),
        flags(own & (fn == FIRE)).alias("fire_flags"),
        (F.sum(F.when(spent & (F.col("flag") == "I"), F.col("amount")).otherwise(0)) / F.sum(F.when(spent, F.col("amount")))).alias("_imputed"),
        F.count(F.lit(1)).alias("n_items"),
    )
    core = ["education_usd", "county_like_functions_usd", "health_usd", "enterprise_usd"]
    taken = F.lit(0)
    for c in core:
        taken = taken + F.col(c)
    base = (
        base.withColumn("general_ex_education_usd", F.col("general_expenditure_usd") - F.col("education_usd"))
        .withColumn("core_municipal_expenditure_usd", F.col("general_expenditure_usd") - taken)
        .withColumns({c: spelled(c) for c in ("police_flags", "fire_flags")})
        .withColumn("unit_imputed_share", half_even("_imputed", 3))
        .withColumn("record_complete", (F.col("police_usd") > 0) & (F.col("n_items") >= min_items) & (F.col("general_expenditure_usd") > 0))
        .drop("_imputed")
    )
    return base.select("*", *share_grid())


def share_grid() -> list[Column]:
    """{police, fire, both} x {general, total, ex_edu, core} percent shares, NULL on incomplete records."""
    bases = {
        "general": "general_expenditure_usd",
        "total": "total_expenditure_usd",
        "general_ex_edu": "general_ex_education_usd",
        "core": "core_municipal_expenditure_usd",
    }
    tops = {"police": F.col("police_usd"), "fire": F.col("fire_usd"), "police_fire": F.col("police_usd") + F.col("fire_usd")}
    return [
        F.when((F.col(d) != 0) & F.col("record_complete"), half_even(top * 100 / F.col(d), 2)).alias(f"{t}_pct_{b}")
        for t, top in tops.items()
        for b, d in bases.items()
    ]


def universe(directory: DataFrame, threshold: int = 100_000) -> DataFrame:
    """Units whose population reaches the threshold in any year."""
    return directory.groupBy("unit").agg(F.max("pop").alias("_pop")).filter(F.col("_pop") >= threshold).select("unit")


def latest_record(df: DataFrame, key: str = "unit", year: str = "year") -> DataFrame:
    """The newest row of each unit."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(year)).alias("_r")).select(key, "_r.*")


def census_year_rows(df: DataFrame, year: str = "year", remainder: int = 2) -> DataFrame:
    """Rows of the latest full-census year (years ending in 2 or 7)."""
    newest = df.filter(F.col(year) % 5 == remainder).agg(F.max(year).alias("_fc"))
    return with_one_row(df, newest).filter(F.col(year) == F.col("_fc")).drop("_fc")


def is_consolidated(name, state, table=None) -> Column:
    """Independent or consolidated government, by state and name prefix."""
    clean = F.regexp_replace(F.regexp_replace(F.upper(F.col(name)), r"\.", ""), "-", " ")
    out = F.col(state) == "VA"
    for prefix, st in table or CONSOLIDATED:
        out = out | ((F.col(state) == st) & clean.startswith(prefix))
    return out


def comparability(metrics: DataFrame, issues: DataFrame | None = None, consolidated: Column | None = None) -> DataFrame:
    """Boolean flags and an ordered note per record; issues(unit, year, status, finding) are appended last, all of them in order."""
    g = F.when(F.col("general_expenditure_usd") == 0, 1).otherwise(F.col("general_expenditure_usd"))
    education, county = F.col("education_usd") * 100 / g, F.col("county_like_functions_usd") * 100 / g
    cons = consolidated if consolidated is not None else F.lit(False)
    contracted = (F.col("police_intergov_usd") > F.col("police_usd")) | (F.col("record_complete") & (F.coalesce(F.col("police_pct_core"), F.lit(100.0)) < 5))
    external = (F.col("fire_usd") == 0) & F.col("record_complete")
    df = metrics.select(
        "*",
        cons.alias("consolidated"),
        (education > 5).alias("runs_schools"),
        (county > 3).alias("county_like"),
        external.alias("fire_external"),
        contracted.alias("police_contracted"),
    )
    touched = ~F.col("police_flags").isin("R", "-") | ~F.col("fire_flags").isin("R", "-")
    notes = [
        (F.col("consolidated"), "consolidated or independent city: carries county functions"),
        (F.col("runs_schools"), "school system inside city books"),
        (F.col("county_like") & ~F.col("consolidated"), "county functions above 3% of general expenditure"),
        (touched, "police or fire contains imputed or adjusted items"),
        (F.coalesce("unit_imputed_share", F.lit(0.0)) > 0.5, "majority of expenditure imputed"),
        (~F.col("record_complete"), "incomplete record: shares null"),
        (F.col("fire_external"), "no fire spending: provided by another government"),
        (F.col("police_contracted"), "police likely contracted"),
        (F.col("fire_intergov_usd") > F.col("fire_usd"), "fire provided by contract"),
    ]
    built = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in notes]))
    if issues is None:
        return df.withColumn("note", F.array_join(built, "; "))
    joined = df.join(issue_lists(issues), ["unit", "year"], "left")
    return joined.withColumn("note", F.array_join(F.concat(built, F.coalesce("_issues", F.array().cast("array<string>"))), "; ")).drop("_issues")


def issue_lists(issues: DataFrame) -> DataFrame:
    """(unit, year, _issues): every issue of a record in order, joined to stretches of the record's list.

    Equal texts are counted before the shuffle.  A range of (record, text) holds one
    stretch of a record's order, so the issues of a record with very many are sorted
    and joined by many tasks, and the last grouping sets the stretches in a row.
    """
    label = F.when(F.col("status") == "verified", "verified issue: ").otherwise("possible issue: ")
    found = issues.select("unit", "year", F.concat(label, F.split("finding", r"\. ")[0]).alias("_f")).filter("_f IS NOT NULL")
    counted = found.groupBy("unit", "year", "_f").agg(F.count(F.lit(1)).alias("_n"))
    laid = counted.repartitionByRange("unit", "year", "_f").withColumn("_part", F.spark_partition_id())
    texts = F.transform(F.sort_array(F.collect_list(F.struct("_f", "_n"))), lambda s: F.array_join(F.array_repeat(s["_f"], s["_n"].cast("int")), "; "))
    stretches = laid.groupBy("unit", "year", "_part").agg(F.array_join(texts, "; ").alias("_text"))
    return stretches.groupBy("unit", "year").agg(F.sort_array(F.collect_list(F.struct("_part", "_text")))["_text"].alias("_issues"))


def flag_class(flags: Column) -> Column:
    """'' when blank, reported, prorated (adds T) or imputed, from an array of one-letter flags."""
    seen = F.filter(flags, lambda f: F.trim(f) != "")
    reported = F.array(*[F.lit(f) for f in REPORTED_FLAGS])
    with_t = F.array(*[F.lit(f) for f in [*REPORTED_FLAGS, PRORATED_FLAG]])
    return (
        F.when(F.size(seen) == 0, "")
        .when(F.size(F.array_except(seen, reported)) == 0, "reported")
        .when(F.size(F.array_except(seen, with_t)) == 0, "prorated")
        .otherwise("imputed")
    )


# Employment item codes.
EMPLOYMENT_CODES = {"000": "total", "062": "police_sworn", "162": "police_other", "024": "fire_firefighters", "124": "fire_other"}


def employment_metrics(rows: DataFrame, population: DataFrame) -> DataFrame:
    """rows(unit, year, code, ft, ft_pay, ft_flag) and population(unit, year, pop) to rates and pay."""
    cells = [
        F.coalesce(F.sum(F.when(F.col("code") == code, F.col(m))), F.lit(0)).alias(f"{name}_{m}")
        for code, name in EMPLOYMENT_CODES.items()
        for m in ("ft", "ft_pay")
    ]
    police = F.collect_set(F.when(F.col("code").isin("062", "162"), F.col("ft_flag")))
    fire = F.collect_set(F.when(F.col("code").isin("024", "124"), F.col("ft_flag")))
    wide = (
        rows.filter(F.col("code").isin(*EMPLOYMENT_CODES))
        .groupBy("unit", "year")
        .agg(*cells, police.alias("_pf"), fire.alias("_ff"))
        .join(population, ["unit", "year"], "left")
    )
    sworn, civil, fighters, other = (F.col(f"{n}_ft") for n in ("police_sworn", "police_other", "fire_firefighters", "fire_other"))
    ratio = lambda a, b: F.when(b != 0, a / b)
    return wide.select(
        "unit",
        "year",
        "pop",
        *[c for c in wide.columns if c.endswith("_ft") or c.endswith("_ft_pay")],
        flag_class(F.col("_pf")).alias("police_flag_class"),
        flag_class(F.col("_ff")).alias("fire_flag_class"),
        ratio(sworn * 1000, F.col("pop")).alias("sworn_per_1k"),
        ratio(fighters * 1000, F.col("pop")).alias("firefighters_per_1k"),
        ratio(civil, sworn + civil).alias("police_civilian_share"),
        ratio(sworn + civil + fighters + other, F.col("total_ft")).alias("police_fire_share_of_city_ft"),
        ratio(F.col("police_sworn_ft_pay") * 12, sworn).alias("sworn_pay_annualised"),
        ratio(F.col("fire_firefighters_ft_pay") * 12, fighters).alias("firefighter_pay_annualised"),
    )


def annual_average(monthly: DataFrame, published: DataFrame) -> DataFrame:
    """published(year, value) where given, else the mean of exactly 12 months: monthly(year, month, value)."""
    means = monthly.groupBy("year").agg(F.avg("value").alias("_mean"), F.count("value").alias("_n")).filter("_n = 12")
    both = means.join(published.withColumnRenamed("value", "_pub"), "year", "full_outer")
    return both.select("year", F.coalesce("_pub", "_mean").alias("value"), F.when(F.col("_pub").isNotNull(), "published").otherwise("mean of 12").alias("basis"))


def deflate(df: DataFrame, index: DataFrame, year: str, value: str, shift: int = 1, fallback: bool = False, name: str = "real") -> DataFrame:
    """Value in money of the index's latest year.

    Finance years use the index of ``year - shift`` (0 for snapshots); NULL when
    it is missing, or the same year's index when ``fallback``.  The index is one
    row per year.
    """
    base = index.agg(F.max_by("value", "year").alias("_base"))
    lagged = index.select((F.col("year") + shift).alias(year), F.col("value").alias("_idx"))
    same = index.select(F.col("year").alias(year), F.col("value").alias("_same"))
    joined = with_one_row(df, base).join(lagged, year, "left")
    if fallback:
        joined = joined.join(same, year, "left").withColumn("_idx", F.coalesce("_idx", "_same")).drop("_same")
    return joined.withColumn(name, F.col(value) * F.col("_base") / F.col("_idx")).drop("_base", "_idx")


def redeflated_trend(df: DataFrame, index: DataFrame, value: str, base_year: int | None = None) -> DataFrame:
    """Median of ``value`` per year in money of the base year of another index, and its ratio to the first year.

    df(year, value); index(year, value).  The base is the index of ``base_year``,
    or its latest where that is missing; a year takes the index of the year
    before, else its own.
    """
    wanted = F.max(F.when(F.col("year") == F.lit(base_year), F.col("value")))
    base = index.agg(F.coalesce(wanted, F.max_by("value", "year")).alias("_base"))
    before = index.select((F.col("year") + 1).alias("year"), F.col("value").alias("_before"))
    own = index.select("year", F.col("value").alias("_own"))
    rows = with_one_row(df.filter(F.col(value).isNotNull()), base).join(before, "year", "left").join(own, "year", "left")
    rows = rows.withColumn("real", F.col(value) * F.col("_base") / F.coalesce("_before", "_own")).filter("real IS NOT NULL")
    trend = exact_quantiles(rows, "year", "real", {"median": 0.5})
    first = trend.agg(F.min_by("median", "year").alias("_first"))
    return with_one_row(trend, first).select("year", "n", "median", (F.col("median") / F.col("_first")).alias("ratio"))


def regional_deflate(df: DataFrame, parity: DataFrame, area: str, year: str, value: str, name: str = "regional_real") -> DataFrame:
    """Divide by the regional price parity (100 = nation) of the previous year: parity(area, year, rpp)."""
    p = parity.select(F.col("area").alias(area), (F.col("year") + 1).alias(year), F.col("rpp").alias("_rpp"))
    return df.join(p, [area, year], "left").withColumn(name, F.col(value) / (F.col("_rpp") / 100)).drop("_rpp")


def undo_real_per_capita(df: DataFrame, value: str, index: str, population: str, name: str = "nominal_total") -> DataFrame:
    """Nominal total from per-head figures that were multiplied by ``index``; rows of aggregates (no unit) are dropped."""
    return df.filter(F.col("unit").isNotNull()).withColumn(name, F.col(value) / F.col(index) * F.col(population))


def allocate_county_spending(parts: DataFrame, counties: DataFrame, own: DataFrame) -> DataFrame:
    """County spending shared out to places by population.

    parts(place, county, part_pop); counties(county, pop, corr, jud, pol), only
    counties with a government; own(place, contracted, own_usd).
    """
    usable = parts.filter("part_pop > 0").join(counties.filter("pop > 0"), "county")
    share = F.least(F.col("part_pop") / F.col("pop"), F.lit(1.0))
    summed = usable.groupBy("place").agg(
        *[F.sum(F.col(k) * share).alias(f"county_{k}_alloc") for k in ("corr", "jud", "pol")], F.count(F.lit(1)).alias("n_counties")
    )
    joined = own.join(summed, "place", "left")
    part = {k: F.coalesce(f"county_{k}_alloc", F.lit(0.0)) for k in ("corr", "jud", "pol")}
    total = F.col("own_usd") + part["corr"] + part["jud"] + F.when(F.col("contracted"), part["pol"]).otherwise(0.0)
    return joined.select(
        "place",
        part["corr"].alias("county_corr_alloc"),
        part["jud"].alias("county_jud_alloc"),
        F.when(F.col("contracted"), part["pol"]).alias("county_pol_alloc"),
        F.coalesce("n_counties", F.lit(0)).alias("n_counties"),
        F.col("n_counties").isNotNull().alias("has_county_government"),
        total.alias("total"),
    )


def neighbour_year(df: DataFrame, key: str, year: str, value: str, default: Column, name: str) -> DataFrame:
    """The value of the year, else the year before, else the year after, else a default."""
    return df.withColumn(name, F.coalesce(F.col(value), calendar_lag(value, key, year, 1), calendar_lag(value, key, year, -1), default))


def crime_coverage(grid: DataFrame) -> DataFrame:
    """grid(unit, year, census_pop, covered_pop, months, violent, property, found) to a coverage class and rates."""
    ratio = F.when((F.col("covered_pop") != 0) & (F.col("census_pop") != 0), F.col("covered_pop") / F.col("census_pop"))
    empty = F.col("violent").isNull() & F.col("property").isNull()
    coverage = (
        F.when(~F.col("found") | empty, "missing")
        .when((ratio > 1.5) | (ratio < 0.67), "not_city")
        .when(F.col("months").isNull(), "unknown")
        .when(F.col("months") >= 12, "full")
        .otherwise("partial")
    )
    usable = F.col("coverage").isin("full", "unknown") & (F.col("census_pop") != 0)
    return (
        grid.withColumn("coverage", coverage)
        .withColumn("population_ratio", F.when(F.col("coverage") != "missing", ratio))
        .withColumn("violent_per_1k", F.when(usable, F.col("violent") * 1000 / F.col("census_pop")))
        .withColumn("property_per_1k", F.when(usable, F.col("property") * 1000 / F.col("census_pop")))
    )


def break_flag(crime: DataFrame, base_years=(2015, 2019), from_year: int = 2020, min_years: int = 3, min_violent: int = 200, min_property: int = 1000) -> DataFrame:
    """Compare with the unit's own median over its full base years (a handful of rows per unit)."""
    counted = (F.col("coverage") == "full") & F.col("violent").isNotNull()
    base = (
        crime.filter(counted & F.col("year").between(*base_years))
        .groupBy("unit")
        .agg(F.median("violent").alias("_mv"), F.median(F.coalesce("property", F.lit(0))).alias("_mp"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= min_years)
    )
    v, p, mv, mp = F.col("violent"), F.coalesce("property", F.lit(0)), F.col("_mv"), F.col("_mp")
    tested = (F.col("year") >= from_year) & v.isNotNull() & (mv >= min_violent)
    low = tested & ((v < 0.6 * mv) | ((mp >= min_property) & (p < 0.5 * mp)))
    high = tested & ((v > 1.8 * mv) | ((mp >= min_property) & (p > 2 * mp)))
    return crime.join(base, "unit", "left").withColumn("consistency", F.when(low, "break_low").when(high, "break_high").otherwise("")).drop("_mv", "_mp", "_n")


def balanced_panel(df: DataFrame, unit: str, year: str, years, complete: Column) -> DataFrame:
    """Units complete in every reference year."""
    good = df.filter(F.col(year).isin(*years) & complete)
    return good.groupBy(unit).agg(F.count_distinct(year).alias("_n")).filter(F.col("_n") == len(years)).select(unit)


def yearly_medians(df: DataFrame, year: str, values: list[str]) -> DataFrame:
    """Exact medians per year, one column per value."""
    long = df.unpivot([year], values, "_measure", "_value")
    med = exact_quantiles(long, [year, "_measure"], "_value", {"median": 0.5})
    return med.groupBy(year).agg(*[F.max(F.when(F.col("_measure") == v, F.col("median"))).alias(f"{v}_median") for v in values], F.max("n").alias("n"))


def panel_series(df: DataFrame, panel: DataFrame, unit: str, year: str, values: list[str], min_share: float = 0.8) -> DataFrame:
    """Yearly medians of the panel, for years where more than ``min_share`` of it has a value."""
    size = panel.agg(F.count(F.lit(1)).alias("_size"))
    medians = yearly_medians(df.join(panel, unit, "left_semi"), year, values)
    return with_one_row(medians, size).filter(F.col("n") > F.col("_size") * min_share).drop("_size")


def composition(df: DataFrame, panel: DataFrame, unit: str, in_set: Column, values: list[str]) -> DataFrame:
    """Inside against outside the panel: n, percent in a set and exact medians."""
    member = panel.select(unit).withColumn("_in", F.lit(True))
    tagged = df.join(member, unit, "left").withColumn("inside", F.coalesce("_in", F.lit(False))).drop("_in")
    counts = tagged.groupBy("inside").agg(F.count(F.lit(1)).alias("n"), (F.avg(in_set.cast("double")) * 100).alias("in_set_pct"))
    return counts.join(yearly_medians(tagged, "inside", values).drop("n"), "inside")


def guarded_corr(df: DataFrame, group, pairs: list[tuple[str, str, str]], more_than: int = 30) -> DataFrame:
    """Named correlations per group, NULL unless more than ``more_than`` pairs exist."""
    aggs = []
    for name, x, y in pairs:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        n = F.count_if(both)
        aggs += [F.when(n > more_than, pair_corr(x, y)).alias(name), n.alias(f"{name}_n")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def quartile_table(df: DataFrame, value: str, tie: str, others: list[str]) -> DataFrame:
    """Four buckets of n // 4 rows by sorted position, the remainder in the last; range and medians of each."""
    rows = with_position(df.filter(F.col(value).isNotNull()).withColumn("_g", F.lit(1)), "_g", value, tie)
    size = F.floor(F.col("group_n") / 4)
    rows = rows.withColumn("quartile", F.least(F.floor((F.col("position") - 1) / size), F.lit(3)).cast("int") + 1)
    ends = rows.groupBy("quartile").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("size"))
    return ends.join(yearly_medians(rows, "quartile", others).drop("n"), "quartile")


def group_medians(df: DataFrame, group: str, value: str, min_size: int = 6) -> DataFrame:
    """Exact median per group of at least ``min_size``."""
    return exact_quantiles(df, group, value, {"median": 0.5}).filter(F.col("n") >= min_size)


def yoy_anomaly(df: DataFrame, unit, year: str, value: str, limit: float = 0.4) -> DataFrame:
    """Rows that moved by more than ``limit`` against the previous available year."""
    unit = [unit] if isinstance(unit, str) else list(unit)
    w = Window.partitionBy(*unit).orderBy(year)
    prev = df.withColumn("prev_year", F.lag(year).over(w)).withColumn("prev", F.lag(value).over(w))
    change = (F.col(value) - F.col("prev")) / F.col("prev")
    return prev.withColumn("change", F.when(F.col("prev") > 0, change)).filter(F.abs("change") > limit)

"""Metro price and wage operators on sparse calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.calendar import calendar_lag, ordinal_month, trailing
from statloom.operators.ordered import with_one_row


def dispersion(df: DataFrame, min_n: int = 8, limit: float = 0.3) -> DataFrame:
    """Population-weighted mean and sd across metros per month, extremes with their owners, composition flag.

    df(metro, m, yoy, pop).  The flag compares the mean with the centred
    three-month mean and is NULL unless all three months exist.
    """
    rows = df.filter("yoy IS NOT NULL")
    sums = rows.groupBy("m").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.col("pop") * F.col("yoy")) / F.sum("pop")).alias("mean"),
        F.min(F.struct("yoy", "metro")).alias("_lo"),
        F.max(F.struct("yoy", "metro")).alias("_hi"),
    ).filter(F.col("n") >= min_n)
    spread = rows.join(sums.select("m", "mean"), "m").groupBy("m").agg((F.sum(F.col("pop") * F.pow(F.col("yoy") - F.col("mean"), F.lit(2))) / F.sum("pop")).alias("_v"))
    out = sums.join(spread, "m").withColumn("_one", F.lit(1))
    # one row per calendar month: the window is as long as the calendar
    near = trailing("_one", "m", -1, 1)
    delta = F.when(F.count("mean").over(near) == 3, F.col("mean") - F.avg("mean").over(near))
    return out.select(
        "m", "n", "mean", F.sqrt("_v").alias("sd"), F.col("_lo.metro").alias("min_metro"), F.col("_lo.yoy").alias("min_yoy"), F.col("_hi.metro").alias("max_metro"),
        F.col("_hi.yoy").alias("max_yoy"), (F.col("_hi.yoy") - F.col("_lo.yoy")).alias("range"), delta.alias("comp_delta"), (F.abs(delta) > limit).alias("comp_flag"),
    )


def schedule(df: DataFrame, look_back: int = 60, skipped: int | None = None, share: float = 0.9) -> DataFrame:
    """monthly, odd or even per metro from the months seen in the look-back to the last month there is: df(metro, m)."""
    rows = with_one_row(df, df.agg(F.max("m").alias("_last")))
    start = F.col("_last") - look_back + 1
    rows = rows.filter(F.col("m") >= start)
    missing = F.lit(0)
    if skipped is not None:
        rows = rows.filter(F.col("m") != skipped)
        missing = F.lit(skipped).between(F.greatest(F.max(start), F.min("m")), F.max("_last")).cast("int")
    possible = F.max("_last") - F.greatest(F.max(start), F.min("m")) + 1 - missing
    g = rows.groupBy("metro").agg(F.count(F.lit(1)).alias("n"), F.count_if(ordinal_month("m") % 2 == 1).alias("odd"), possible.alias("_possible"))
    kind = F.when(F.col("n") >= F.col("_possible") * share, "monthly").when(F.col("odd") > F.col("n") - F.col("odd"), "odd").otherwise("even")
    return g.select("metro", "n", "odd", kind.alias("schedule"))


def area_dimension(df: DataFrame, schedules: DataFrame, approximate: DataFrame) -> DataFrame:
    """Metro with first and last month, schedule and a flag for approximate geography."""
    span = df.groupBy("metro").agg(F.min("m").alias("first_m"), F.max("m").alias("last_m"))
    flag = approximate.select("metro", F.lit(True).alias("_a"))
    return span.join(schedules.select("metro", "schedule"), "metro", "left").join(flag, "metro", "left").select("metro", "first_m", "last_m", "schedule", F.coalesce("_a", F.lit(False)).alias("approximate"))


def real_wages(wages: DataFrame, prices: DataFrame) -> DataFrame:
    """wage growth minus the price growth of the last published month inside the quarter.

    wages(metro, q, own, yoy) with own '5' private (preferred) and '0' all; prices(metro, m, yoy), q = quarter ordinal.
    """
    q = F.floor((F.col("m") - 1) / 3).cast("int")
    cpi = prices.filter("yoy IS NOT NULL").groupBy("metro", q.alias("q")).agg(F.max(F.struct("m", "yoy")).alias("_c"))
    w = wages.groupBy("metro", "q").agg(F.max(F.when(F.col("own") == "5", F.col("yoy"))).alias("_p"), F.max(F.when(F.col("own") == "0", F.col("yoy"))).alias("_t"))
    wage = F.coalesce("_p", "_t")
    rows = w.filter(wage.isNotNull()).join(cpi, ["metro", "q"])
    return rows.select(
        "metro", "q", wage.alias("wage_yoy"), F.when(F.col("_p").isNotNull(), "5").otherwise("0").alias("wage_own"), F.col("_c.yoy").alias("cpi_yoy"), F.col("_c.m").alias("month_used"), (wage - F.col("_c.yoy")).alias("real_yoy")
    )


def shelter_gap(rent: DataFrame, market: DataFrame, lag: int = 12) -> DataFrame:
    """Rent growth minus the market index growth ``lag`` months earlier: both (metro, m, yoy)."""
    moved = market.filter("yoy IS NOT NULL").select("metro", (F.col("m") + lag).cast("int").alias("m"), F.col("yoy").alias("market_yoy_lagged"))
    return rent.filter("yoy IS NOT NULL").join(moved, ["metro", "m"]).withColumn("gap", F.col("yoy") - F.col("market_yoy_lagged"))


def recent_extract(df: DataFrame, keys: list[str], months: int = 96) -> DataFrame:
    """Latest value per key and its last ``months`` values as one ordered array."""
    last = df.groupBy(*keys).agg(F.max("m").alias("_last"))
    rows = df.join(last, keys).filter(F.col("m") > F.col("_last") - months)
    packed = rows.groupBy(*keys).agg(F.max(F.struct("m", "value")).alias("_l"), F.sort_array(F.collect_list(F.struct("m", "value"))).alias("_s"))
    return packed.select(*keys, F.col("_l.m").alias("last_m"), F.col("_l.value").alias("last_value"), F.size("_s").alias("n"), F.transform("_s", lambda s: s["value"]).alias("series"))


def sparse_yoy(df: DataFrame, key: str, value: str) -> DataFrame:
    prev = calendar_lag(value, key, "m", 12)
    return df.withColumn("yoy", F.when(prev > 0, (F.col(value) / prev - 1) * 100))

"""Windowed feed measures.  Functions built on ``window`` also run on streams with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.calendar import calendar_lag, trailing
from statloom.operators.ordered import exact_quantiles, top_k, with_position, with_prior_max


def bucket_last(df: DataFrame, key: str, ts: str, value: str, width: str = "5 minutes") -> DataFrame:
    """Last sample of each bucket."""
    return df.groupBy(key, F.window(ts, width).alias("w")).agg(F.max_by(value, F.struct(ts, value)).alias(value)).select(key, F.col("w.start").alias("bucket"), value)


def bucket_extreme(df: DataFrame, key: str, ts: str, value: str, centre: float, width: str = "5 minutes") -> DataFrame:
    """Sample furthest from the centre in each bucket, the later one on ties."""
    far = F.max_by(value, F.struct(F.abs(F.col(value) - centre), F.col(ts), F.col(value)))
    return df.groupBy(key, F.window(ts, width).alias("w")).agg(far.alias(value)).select(key, F.col("w.start").alias("bucket"), value)


def daily_summary(df: DataFrame, key: str, ts: str, value: str, full: float = 99.0) -> DataFrame:
    """Per day: last sample, mean, how many samples at zero and at or above ``full``."""
    return (
        df.groupBy(key, F.window(ts, "1 day").alias("w"))
        .agg(
            F.max_by(value, F.struct(ts, value)).alias("last"),
            F.avg(value).alias("mean"),
            F.count_if(F.col(value) == 0).alias("at_zero"),
            F.count_if(F.col(value) >= full).alias("at_full"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(key, F.to_date("w.start").alias("day"), "last", "mean", "at_zero", "at_full", "n")
    )


def sliding_total(daily: DataFrame, key: str, day: str, value: str, days: int = 7) -> DataFrame:
    """Total of the last ``days`` days where every one of them is present: ``day`` is an integer day number."""
    w = trailing(key, day, -(days - 1))
    return daily.withColumn("total", F.when(F.count(value).over(w) == days, F.sum(value).over(w))).filter("total IS NOT NULL")


def lookback(df: DataFrame, key: str, ts: str, value: str, now: Column, hours=(3, 6, 12, 24)) -> DataFrame:
    """Counts, min, max and peak time over several look-back windows in one pass."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    aggs = []
    for h in hours:
        inside = (age >= 0) & (age < h * 3_600_000_000)
        v = F.when(inside, F.col(value))
        aggs += [F.count(v).alias(f"n_{h}h"), F.min(v).alias(f"min_{h}h"), F.max(v).alias(f"max_{h}h")]
    widest = F.when((age >= 0) & (age < max(hours) * 3_600_000_000), F.struct(value, ts))
    return df.groupBy(key).agg(*aggs, F.max(widest)[ts].alias("peak_at"))


def windowed_rate(df: DataFrame, key: str, ts: str, now: Column, lag_hours: int, span_hours: int) -> DataFrame:
    """Events per hour in a window that ends a fixed lag before now."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 3_600_000_000
    return df.groupBy(key).agg((F.count_if((age >= lag_hours) & (age < lag_hours + span_hours)) / F.lit(float(span_hours))).alias("rate"))


def sliding_counts(df: DataFrame, key: str, ts: str, width: str, slide: str, watermark: str | None = None) -> DataFrame:
    """Counts per sliding window; on a stream rows later than the watermark are dropped."""
    src = df.withWatermark(ts, watermark) if watermark else df
    return src.groupBy(F.window(ts, width, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def drop_incomplete_tail(weekly: DataFrame, key: str, week: str, n: str, share: float = 0.8) -> DataFrame:
    """Cut trailing weeks with fewer than ``share`` of the week before, repeatedly from the end.

    A week survives when itself or any later week holds up against its predecessor.
    """
    w = Window.partitionBy(key).orderBy(week)
    ok = F.coalesce(F.col(n) >= F.lag(n).over(w) * share, F.lit(True))
    tagged = weekly.withColumn("_ok", ok)
    later = Window.partitionBy(key).orderBy(week).rowsBetween(0, Window.unboundedFollowing)
    return tagged.withColumn("_keep", F.max("_ok").over(later)).filter("_keep").drop("_ok", "_keep")


def guarded_weekly_mean(df: DataFrame, key: str, week: str, site: str, value: str, cap: float = 100.0) -> DataFrame:
    """Mean over sites of values at or below the cap, with the site count."""
    return df.filter(F.col(value) <= cap).groupBy(key, week).agg(F.avg(value).alias("mean"), F.count_distinct(site).alias("sites"), F.count(F.lit(1)).alias("n"))


def category_share(df: DataFrame, by: list[str], category: str, value: str, chosen: list[str]) -> DataFrame:
    """Percent of positive output that comes from the chosen categories; storage draw (negative) is left out."""
    pos = F.when(F.col(value) > 0, F.col(value))
    return df.groupBy(*by).agg((F.coalesce(F.sum(F.when(F.col(category).isin(*chosen), pos)), F.lit(0.0)) * 100 / F.sum(pos)).alias("share"), F.sum(pos).alias("total"))


def row_sum(columns: list[str]) -> Column:
    """Sum over the columns that have a value; NULL when none has."""
    present = F.array_compact(F.array(*[F.col(c) for c in columns]))
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, b: a + b))


def settled_latest(df: DataFrame, key: str, ts: str, actual: str, forecast: str, now: Column) -> DataFrame:
    """Latest observed value up to now, the latest forecast, and headroom = forecast - actual of the same row."""
    seen = (F.col(ts) <= now) & F.col(actual).isNotNull()
    last = F.max(F.when(seen, F.struct(ts, actual, forecast)))
    return df.groupBy(key).agg(last.alias("_l"), F.count_if(~seen).alias("unsettled")).select(key, F.col(f"_l.{ts}").alias("at"), F.col(f"_l.{actual}").alias("value"), (F.col(f"_l.{forecast}") - F.col(f"_l.{actual}")).alias("headroom"), "unsettled")


def latest_then_worst(df: DataFrame, site: str, kind: str, ts: str, value: str) -> DataFrame:
    """Latest reading per (site, kind), then the highest reading per kind with its site."""
    latest = df.groupBy(site, kind).agg(F.max(F.struct(ts, value)).alias("_l")).select(site, kind, F.col(f"_l.{value}").alias(value))
    return latest.groupBy(kind).agg(F.max(F.struct(value, site)).alias("_w"), F.count(F.lit(1)).alias("sites")).select(kind, F.col(f"_w.{value}").alias(value), F.col(f"_w.{site}").alias(site), "sites")


def calendar_yoy(df: DataFrame, key: str, month: str, value: str) -> DataFrame:
    prev = calendar_lag(value, key, month, 12)
    return df.withColumn("yoy", F.when(prev > 0, (F.col(value) / prev - 1) * 100)).filter("yoy IS NOT NULL")


def offset_difference(df: DataFrame, key: str, order: str, value: str, back: int = 252) -> DataFrame:
    """Change against ``back`` rows earlier, or against the first row when there are fewer.

    For merged series: a key holds at most its history of points.
    """
    w = Window.partitionBy(key).orderBy(order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("change", F.col(value) - F.coalesce(F.lag(value, back).over(w), first))


def normalise_odds(df: DataFrame, event: str, p: str, move: str) -> DataFrame:
    """Outcome odds scaled to 1 per event: expected move, total of cuts and of hikes (one small ladder per event)."""
    sums = df.filter(F.col(p).isNotNull()).groupBy(event).agg(
        F.sum(p).alias("_t"), F.sum(F.col(p) * F.col(move)).alias("_e"), F.sum(F.when(F.col(move) < 0, F.col(p)).otherwise(0.0)).alias("_c"), F.sum(F.when(F.col(move) > 0, F.col(p)).otherwise(0.0)).alias("_h")
    ).filter("_t > 0")
    return sums.select(event, (F.col("_e") / F.col("_t")).alias("expected"), (F.col("_c") / F.col("_t")).alias("cuts"), (F.col("_h") / F.col("_t")).alias("hikes"))


def nearest_event(events: DataFrame, key: str, at: str, now: Column) -> DataFrame:
    """First event still ahead per key, else the first of all."""
    return events.groupBy(key).agg(F.coalesce(F.min(F.when(F.col(at) >= now, F.col(at))), F.min(at)).alias("at"))


def best_per_group(df: DataFrame, group: str, order: list, first: int = 1) -> DataFrame:
    return top_k(df, group, order, first)


def upper_median(df: DataFrame, group, value: str) -> DataFrame:
    return exact_quantiles(df, group, value, {"upper_median": 0.5}, "upper")


def running_over_threshold(df: DataFrame, key: str, order: str, tie: str, value: str, threshold: float) -> DataFrame:
    """Running count of rows over the threshold, in (order, tie) order; both are numeric."""
    return with_position(df.filter(F.col(value) >= threshold), key, order, tie, "running", 26)


def running_records(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows that beat everything before them; ``order`` is numeric and unique per key."""
    best = with_prior_max(df, key, order, value, "_best")
    return best.filter(F.col("_best").isNull() | (F.col(value) > F.col("_best"))).drop("_best")


def degraded_count(status: DataFrame, source: str, state: str, good: str = "operational") -> DataFrame:
    """How many sources answered, how many of those are degraded; a source without an answer is not counted."""
    per = status.groupBy(source).agg(F.max((F.col(state) != good).cast("int")).alias("_bad"), F.count(state).alias("_n"))
    return per.agg(F.sum(F.when(F.col("_n") > 0, F.col("_bad"))).alias("degraded"), F.count_if(F.col("_n") > 0).alias("answered"), F.count(F.lit(1)).alias("sources"))


def trailing_max(df: DataFrame, key: str, order: str, value: str, rows: int = 132) -> DataFrame:
    """Maximum over the last ``rows`` points of a merged series (at most its history long)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("trailing_max", F.max(value).over(w))


def latest_per_source(df: DataFrame, source: str, order: list, n: int) -> DataFrame:
    return top_k(df, source, order, n)


def latest_non_null(df: DataFrame, key: str, ts: str, fields: list[str]) -> DataFrame:
    """Each field's own last reading and when it was."""
    aggs = []
    for f in fields:
        last = F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(f).alias("v"))))
        aggs += [last["v"].alias(f), last["t"].alias(f"{f}_at")]
    return df.groupBy(key).agg(*aggs)


def fast_headline(minute: DataFrame, official: DataFrame, key: str) -> DataFrame:
    """Value from the fast feed next to the official series' extent: minute, official(key, ts, value)."""
    fast = minute.groupBy(key).agg(F.max(F.struct("ts", "value"))["value"].alias("value"))
    slow = official.groupBy(key).agg(F.count(F.lit(1)).alias("points"), F.max("ts").alias("official_at"), F.max(F.struct("ts", "value"))["value"].alias("official_value"))
    return slow.join(fast, key, "left")


def forecast_for(observed: DataFrame, forecast: DataFrame, key: str, month: str) -> DataFrame:
    """Forecast of the observed month, else the first forecast there is."""
    first = forecast.groupBy(key).agg(F.min_by("value", month).alias("_first"))
    same = forecast.select(key, month, F.col("value").alias("_same"))
    return observed.join(same, [key, month], "left").join(first, key, "left").select(*observed.columns, F.coalesce("_same", "_first").alias("forecast"))

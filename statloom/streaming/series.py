"""Metric feeds: merging series, snapshots, run gates, staleness and roll-ups.

Every function works on a batch DataFrame; ``keyed`` holds the same rules as
streaming state.  Late points always merge by timestamp; only ``history`` bounds
what is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.calendar import cadence_millis
from statloom.operators.ordered import order_bucket

# Levels from calm to worst.
LEVELS = ["unknown", "good", "warning", "serious", "critical"]


def epoch_us(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def keep_last(df: DataFrame, key: str, order: str, history, newest: bool = True, tie: str | None = None) -> DataFrame:
    """The last (or first) ``history`` rows of each key by a whole-number order column, ties by ``tie``.

    Counts per order bucket decide which buckets are kept whole and which one is
    cut, so only that one bucket of a key is ever sorted.  Buckets are those of
    the distance from the key's smallest value: a span of a few hours far from
    zero is still cut finely.
    """
    limit = F.lit(history) if isinstance(history, int) else history
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    rows = df.join(first, key).withColumn("_bucket", order_bucket(F.col(order) - F.col("_first"), 20)).withColumn("_limit", limit).drop("_first")
    counts = rows.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    direction = F.desc("_bucket") if newest else F.asc("_bucket")
    w = Window.partitionBy(key).orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    joined = rows.join(counts, [key, "_bucket"]).filter(F.col("_before") < F.col("_limit"))
    whole = joined.filter(F.col("_before") + F.col("_n") <= F.col("_limit"))
    cut = joined.filter(F.col("_before") + F.col("_n") > F.col("_limit"))
    ties = [] if tie is None else [tie]
    local = Window.partitionBy(key, "_bucket").orderBy(F.desc(order) if newest else F.asc(order), *ties)
    cut = cut.withColumn("_rn", F.row_number().over(local)).filter(F.col("_rn") <= F.col("_limit") - F.col("_before")).drop("_rn")
    return whole.unionByName(cut).drop("_bucket", "_limit", "_n", "_before")


def merge_series(state: DataFrame | None, batch: DataFrame, history, replace: bool = False) -> DataFrame:
    """Union by (id, ts) where the newest fetch wins; missing values dropped; last ``history`` points kept.

    Rows are (id, ts, value, fetched).  ``replace`` drops the old points of ids in the batch.
    """
    fresh = batch.select("id", "ts", "value", "fetched")
    if state is not None:
        old = state.select("id", "ts", "value", "fetched")
        fresh = fresh.unionByName(old.join(batch.select("id").distinct(), "id", "left_anti") if replace else old)
    ok = fresh.filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("ts").isNotNull())
    merged = ok.groupBy("id", "ts").agg(F.max_by("value", F.struct("fetched", "value")).alias("value"), F.max("fetched").alias("fetched"))
    return keep_last(merged.withColumn("_us", epoch_us("ts")), "id", "_us", history).drop("_us")


def snapshot(series: DataFrame) -> DataFrame:
    """Latest value, change against the previous point, and min/max/n of the kept history (bounded by it)."""
    w = Window.partitionBy("id").orderBy("ts")
    prev = series.withColumn("_prev", F.lag("value").over(w))
    out = prev.groupBy("id").agg(
        F.max_by(F.struct("value", "_prev"), "ts").alias("_l"), F.max("ts").alias("at"), F.max("fetched").alias("fetched_at"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n")
    )
    return out.select("id", F.col("_l.value").alias("value"), (F.col("_l.value") - F.col("_l._prev")).alias("delta"), "at", "fetched_at", "min", "max", "n")


def due_feeds(registry: DataFrame, runs: DataFrame, now: Column, force: Column | None = None, has_key: Column | None = None) -> DataFrame:
    """run / skip per feed: forced, never fetched, or older than 95% of its cadence; a missing key skips."""
    joined = registry.join(runs, "id", "left")
    age = (epoch_us(now) - epoch_us("last_fetch")) / 1000
    due = F.coalesce(force, F.lit(False)) if force is not None else F.lit(False)
    due = due | F.col("last_fetch").isNull() | (age >= cadence_millis("cadence") * 0.95)
    allowed = has_key if has_key is not None else F.lit(True)
    return joined.withColumn("action", F.when(~allowed, "skipped").when(due, "run").otherwise("fresh"))


def keep_last_good(state: DataFrame, results: DataFrame) -> DataFrame:
    """A failed fetch keeps the stored value, adds its error and counts up; success resets.

    state(id, value, at, error_count); results(id, value, at, error).
    """
    new = results.select("id", F.col("value").alias("_v"), F.col("at").alias("_at"), F.col("error").alias("_err"), F.lit(True).alias("_ran"))
    j = state.join(new, "id", "full_outer")
    ran, failed = F.coalesce("_ran", F.lit(False)), F.col("_err").isNotNull()
    good = ran & ~failed
    return j.select(
        "id",
        F.when(good, F.col("_v")).otherwise(F.col("value")).alias("value"),
        F.when(good, F.col("_at")).otherwise(F.col("at")).alias("at"),
        F.when(ran & failed, F.col("_err")).alias("last_error"),
        F.when(good, 0).when(ran & failed, F.coalesce("error_count", F.lit(0)) + 1).otherwise(F.coalesce("error_count", F.lit(0))).cast("int").alias("error_count"),
    )


def ladder(value, rules) -> Column:
    """Level of the first rule whose bounds all hold; no rules or no value is 'unknown', no hit is 'good'."""
    v = F.col(value) if isinstance(value, str) else value
    r = F.col(rules) if isinstance(rules, str) else rules

    def holds(rule):
        return (
            (rule["gte"].isNull() | (v >= rule["gte"]))
            & (rule["gt"].isNull() | (v > rule["gt"]))
            & (rule["lte"].isNull() | (v <= rule["lte"]))
            & (rule["lt"].isNull() | (v < rule["lt"]))
            & (rule["eq"].isNull() | (v == rule["eq"]))
        )

    hit = F.try_element_at(F.filter(r, holds), F.lit(1))
    return F.when(v.isNull() | F.isnan(v) | r.isNull() | (F.size(r) == 0), "unknown").otherwise(F.coalesce(hit["level"], F.lit("good")))


def level_ordinal(level) -> Column:
    c = F.col(level) if isinstance(level, str) else level
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), c).cast("int")


def level_name(ordinal) -> Column:
    c = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), c)


def stale_flag(now: Column, stale_after: str = "stale_after") -> Column:
    """Older than staleAfter, or than max(3 x cadence, 2 h); events age from their fetch, metrics from the observation."""
    window = F.coalesce(cadence_millis(stale_after), F.greatest(cadence_millis("cadence") * 3, F.lit(7_200_000)))
    ref = F.when(F.col("kind") == "events", F.col("fetched_at")).otherwise(F.col("at"))
    return F.coalesce((epoch_us(now) - epoch_us(ref)) / 1000 > window, F.lit(False))


def effective_level(status, stale, failed) -> Column:
    """A stale or failing feed reads at least 'warning'."""
    base = level_ordinal(status)
    return level_name(F.when(F.col(stale) | F.col(failed), F.greatest(base, F.lit(LEVELS.index("warning") + 1))).otherwise(base))


def worst_levels(df: DataFrame, section: str = "section", level: str = "effective") -> DataFrame:
    """Worst level per section and for the whole site (section NULL); unknown only counts when alone."""
    return df.rollup(section).agg(F.max(level_ordinal(level)).alias("_o"), F.count(F.lit(1)).alias("n")).select(section, level_name("_o").alias("level"), "n")


def health(df: DataFrame, now: Column) -> DataFrame:
    """Minutes since observation and since fetch, with errors."""
    minutes = lambda c: (epoch_us(now) - epoch_us(c)) / 60_000_000
    return df.select("id", minutes("at").alias("data_age_min"), minutes("fetched_at").alias("fetch_age_min"), F.col("error_count") > 0)


def upsert_on_date(series: DataFrame, live: DataFrame) -> DataFrame:
    """The live price replaces the bar of its date: series(id, day, value), live(id, day, value)."""
    return series.join(live.select("id", "day"), ["id", "day"], "left_anti").unionByName(live)

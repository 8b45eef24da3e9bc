"""Vintaged observations: appends, latest views, revisions, transition tables, stress composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.calendar import calendar_lag, trailing, month_grid
from statloom.functions.stats import half_away
from statloom.operators.ordered import exact_quantiles, shared


def changed_observations(incoming: DataFrame, latest: DataFrame, keys: list[str], value: str = "value", stage: str | None = None, pull_id=None, eps: float = 1e-9) -> DataFrame:
    """Rows that are new, moved by more than eps, or (with ``stage``) changed stage; stamped with the pull."""
    old = latest.select(*keys, F.col(value).alias("_old"), *([F.col(stage).alias("_stage")] if stage else []))
    joined = incoming.join(old, keys, "left")
    moved = F.col("_old").isNull() | (F.abs(F.col(value) - F.col("_old")) > eps)
    if stage:
        moved = moved | ~F.col(stage).eqNullSafe(F.col("_stage"))
    out = joined.filter(moved).drop("_old", "_stage")
    return out if pull_id is None else out.withColumn("pull_id", F.lit(pull_id))


def latest_vintage(obs: DataFrame, keys: list[str], order: str = "pull_id") -> DataFrame:
    rest = [c for c in obs.columns if c not in keys]
    return obs.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def new_vintages(incoming: DataFrame, stored: DataFrame, retain: int = 98) -> DataFrame:
    """Vintages past the stored maximum of each series, keeping observations within ``retain`` months of the vintage."""
    top = stored.groupBy("series").agg(F.max("vintage_m").alias("_top"))
    joined = incoming.join(top, "series", "left")
    return joined.filter((F.col("_top").isNull() | (F.col("vintage_m") > F.col("_top"))) & (F.col("obs_m") >= F.col("vintage_m") - retain)).drop("_top")


def vintage_changes(levels: DataFrame) -> DataFrame:
    """Month-on-month percent change inside each vintage; gaps give NULL, rows without a change are left out."""
    prev = calendar_lag("value", ["series", "vintage_m"], "obs_m", 1)
    return levels.withColumn("mom", (F.col("value") / prev - 1) * 100).filter(F.col("mom").isNotNull()).select("series", "vintage_m", "obs_m", "mom")


def matrix_to_long(wide: DataFrame, series: str = "series", obs_m: str = "obs_m", prefix: str = "v") -> DataFrame:
    """One column per vintage to rows (series, vintage, obs_m, value, mom) on every month between a vintage's first and last value."""
    names = [c for c in wide.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    vintage = F.substr("_c", F.lit(len(prefix) + 1)).cast("int")
    long = wide.select(series, obs_m, *names).unpivot([series, obs_m], names, "_c", "value").withColumn("vintage", vintage).filter("value IS NOT NULL").drop("_c")
    keys = [series, "vintage"]
    grid = month_grid(long, keys, obs_m).join(long, [*keys, obs_m], "left")
    before = calendar_lag("value", keys, obs_m, 1)
    return grid.select(*keys, obs_m, "value", ((F.col("value") / before - 1) * 100).alias("mom"))


def revisions(mom: DataFrame, days: int = 365) -> DataFrame:
    """First print, print at least a year later, latest print per observation: mom(series, vintage date, obs_m, mom).

    Observations older than the newest one of the oldest archived vintage were
    already revised when the archive began: ``true_first`` is false for them.
    """
    per_obs = ["series", "obs_m"]
    firsts = mom.groupBy(*per_obs).agg(F.min("vintage").alias("_fv"))
    joined = mom.join(firsts, per_obs)
    late = F.col("vintage") >= F.date_add("_fv", days)
    out = joined.groupBy(*per_obs).agg(
        F.min_by("mom", "vintage").alias("first_print"),
        F.min("vintage").alias("first_vintage"),
        F.min_by(F.when(late, F.col("mom")), F.when(late, F.col("vintage"))).alias("after_1y"),
        F.max_by("mom", "vintage").alias("latest"),
        F.count(F.lit(1)).alias("n_vintages"),
    )
    archive = mom.groupBy("series").agg(F.min("vintage").alias("_v0"))
    start = mom.join(archive, "series").filter("vintage = _v0").groupBy("series").agg(F.max("obs_m").alias("_m0"))
    return out.join(start, "series").select(
        *per_obs,
        "first_print",
        "first_vintage",
        "after_1y",
        "latest",
        (F.col("after_1y") - F.col("first_print")).alias("rev_1y"),
        (F.col("latest") - F.col("first_print")).alias("rev_latest"),
        "n_vintages",
        (F.col("obs_m") >= F.col("_m0")).alias("true_first"),
    )


def transitions(rev: DataFrame) -> DataFrame:
    """Counts of rounded first print against rounded latest print, and the share of each first value that changed."""
    cells = (
        rev.filter(F.col("first_print").isNotNull() & F.col("latest").isNotNull())
        .groupBy("series", half_away("first_print").alias("first"), half_away("latest").alias("last"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = cells.groupBy("series", "first").agg(
        F.sum("n").alias("_n"), F.coalesce(F.sum(F.when(F.col("first") == F.col("last"), F.col("n"))), F.lit(0)).alias("_same")
    )
    return cells.join(totals, ["series", "first"]).select("series", "first", "last", "n", (1 - F.col("_same") / F.col("_n")).alias("share_changed"))


def revision_stats(rev: DataFrame, group: list[str], min_n: int = 3) -> DataFrame:
    """Mean, mean absolute, sample sd, exact percentiles, shares beyond .1 and .2, sign flips per group."""
    x = F.col("rev_latest")
    rows = rev.filter(x.isNotNull())
    flip = ((F.col("first_print") > 0) != (F.col("latest") > 0)).cast("double")
    base = rows.groupBy(*group).agg(
        F.avg(x).alias("mean_rev"),
        F.avg(F.abs(x)).alias("mean_abs_rev"),
        F.stddev_samp(x).alias("sd_rev"),
        F.avg(F.abs("rev_1y")).alias("mean_abs_rev_1y"),
        F.avg((F.abs(x) >= 0.1).cast("double")).alias("share_ge_01"),
        F.avg((F.abs(x) >= 0.2).cast("double")).alias("share_ge_02"),
        F.avg(flip).alias("share_sign_flip"),
    )
    signed = exact_quantiles(rows, group, "rev_latest", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    size = exact_quantiles(rows.withColumn("_abs", F.abs(x)), group, "_abs", {"p90_abs": 0.9}).drop("n")
    return signed.join(size, group).join(base, group).filter(F.col("n") >= min_n)


def trend_noise(rev: DataFrame, mom: DataFrame, errors: DataFrame, min_months: int = 9, width: float = 1.5) -> DataFrame:
    """First print against the mean of the prior 12 months in the same vintage: errors(series, year, se).

    The standard error of the observation's year is used, else the latest
    earlier year, else the earliest year there is.
    """
    back = mom.withColumn("trail12", F.avg("mom").over(trailing(["series", "vintage"], "obs_m", -12, -1))).withColumn(
        "n_trail", F.count("mom").over(trailing(["series", "vintage"], "obs_m", -12, -1))
    )
    own = back.select("series", "obs_m", F.col("vintage").alias("first_vintage"), "trail12", "n_trail")
    rows = rev.select("series", "obs_m", "first_vintage", "first_print").join(own, ["series", "obs_m", "first_vintage"]).filter(F.col("n_trail") >= min_months)
    rows = rows.withColumn("year", F.floor((F.col("obs_m") - 1) / 12).cast("int"))
    picked = as_of(rows, errors, "series", "year", "year", "se")
    gap = F.abs(F.col("first_print") - F.col("trail12"))
    return picked.select("series", "obs_m", "first_print", "trail12", "n_trail", "se", F.col("matched").alias("se_year"), gap.alias("gap"), (gap < F.col("se") * width).alias("within"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, value: str) -> DataFrame:
    """Latest right row at or before the left one, else the earliest right row.

    The right side, one row per key and time, is what is ordered; left rows are
    first reduced to their distinct times, so a key's left rows never share a
    window.  Matches come back by an equality join on (key, time), whose hot keys
    adaptive execution can split.
    """
    r = right.select(F.col(key).alias("_key"), F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_on).alias("t"), F.col(value).alias("v")).alias("_r"))
    first = r.groupBy("_key").agg(F.min_by("_r", "_t").alias("_first"))
    times = left.select(F.col(key).alias("_key"), F.col(left_on).alias("_t")).distinct().withColumn("_side", F.lit(1))
    order = Window.partitionBy("_key").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = r.unionByName(times, allowMissingColumns=True).withColumn("_seen", F.last("_r", ignorenulls=True).over(order)).filter("_side = 1")
    hit = seen.join(first, "_key", "left").select("_key", "_t", F.coalesce("_seen", "_first").alias("_hit"))
    rows = left.join(hit, left[key].eqNullSafe(hit["_key"]) & left[left_on].eqNullSafe(hit["_t"]))
    return rows.select(*left.columns, F.col("_hit.t").alias("matched"), F.col("_hit.v").alias(value))


def fan(mom: DataFrame, months: int = 36) -> DataFrame:
    """Changes of the last observation months by vintage, as rows (series, vintage, obs_m, mom)."""
    last = mom.groupBy("series").agg(F.max("obs_m").alias("_last"))
    return mom.join(last, "series").filter(F.col("obs_m") > F.col("_last") - months).drop("_last")


def stress_composite(df: DataFrame, baseline: Column, domains: DataFrame, min_points: int = 6) -> DataFrame:
    """z and pp against the baseline period, averaged inside a domain and then across domains.

    df(month, component, value); domains(component, domain).  Components with a
    flat or short baseline are left out; missing values are skipped at each level.
    """
    base = (
        df.filter(baseline & F.col("value").isNotNull())
        .groupBy("component")
        .agg(F.avg("value").alias("_mu"), F.stddev_pop("value").alias("_sd"), F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") >= min_points) & (F.col("_sd") > 0))
    )
    scored = shared(
        df.filter(F.col("value").isNotNull())
        .join(base, "component")
        .join(domains, "component")
        .select("month", "component", "domain", ((F.col("value") - F.col("_mu")) / F.col("_sd")).alias("z"), (F.col("value") - F.col("_mu")).alias("pp"))
    )
    by_domain = scored.groupBy("month", "domain").agg(F.avg("z").alias("z"), F.avg("pp").alias("pp"))
    total = by_domain.groupBy("month").agg(F.avg("z").alias("z"), F.avg("pp").alias("pp")).withColumn("component", F.lit("_composite"))
    return scored.select("month", "component", "z", "pp").unionByName(total.select("month", "component", "z", "pp"))


def level_revision(vintages: DataFrame, current: DataFrame) -> DataFrame:
    """Initial (published in its own month) to current level in percent, and its change over 12 months."""
    first = vintages.filter("pub_m = m").select("item", "m", F.col("value").alias("initial"))
    both = first.join(current.select("item", "m", F.col("value").alias("current")), ["item", "m"])
    pct = both.withColumn("rev_idx", F.col("current") - F.col("initial")).withColumn("rev_pct", (F.col("current") / F.col("initial") - 1) * 100)
    return pct.withColumn("rev_yoy_pp", F.col("rev_pct") - calendar_lag("rev_pct", "item", "m", 12))


def multi_vintage_cells(obs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Cells stored more than once with the span of their values."""
    return obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).filter("n > 1")

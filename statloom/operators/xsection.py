"""Weighted statistics across items, per month and universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.calendar import trailing
from statloom.functions.stats import pair_corr
from statloom.operators.ordered import running_totals, value_ranks, with_group_totals, with_one_row, with_position, with_ranks


def weighted_distribution(
    df: DataFrame,
    group,
    x: str,
    w: str,
    percentiles=(10, 25, 50, 75, 90),
    trims=(8, 16),
    above=(2, 4, 6),
    min_items: int = 20,
    min_weight: float | Column = 60.0,
) -> DataFrame:
    """Step percentiles, trimmed means, population moments and shares of covered weight.

    Rows with equal x are merged first; a step percentile is the first x whose
    running weight reaches p, and a trimmed mean keeps of each x the part of its
    weight interval inside [a, 1 - a].
    """
    group = [group] if isinstance(group, str) else list(group)
    rows = df.filter(F.col(x).isNotNull() & (F.col(w) > 0)).select(
        *group, F.col(x).alias("x"), F.col(w).alias("w"), (F.col(w) * F.col(x)).alias("wx"), F.lit(1).cast("bigint").alias("n")
    )
    run = running_totals(rows, group, "x", ["w", "wx", "n"])
    share = F.col("w") / F.col("w_total")
    upto = F.col("w_run") / F.col("w_total")
    d = F.col("x") - F.col("wx_total") / F.col("w_total")
    scored = run.withColumn("_s", share).withColumn("_u", upto).withColumn("_d", d)

    def kept(a):
        return F.greatest(F.least(F.col("_u"), F.lit(1 - a)) - F.greatest(F.col("_u") - F.col("_s"), F.lit(a)), F.lit(0.0))

    aggs = [
        F.max("n_total").alias("n"),
        F.max("w_total").alias("covered"),
        (F.max("wx_total") / F.max("w_total")).alias("wmean"),
        F.sum(F.col("_s") * F.pow("_d", F.lit(2))).alias("_m2"),
        F.sum(F.col("_s") * F.pow("_d", F.lit(3))).alias("_m3"),
        F.sum(F.col("_s") * F.pow("_d", F.lit(4))).alias("_m4"),
    ]
    aggs += [F.min(F.when(F.col("_u") >= p / 100.0, F.col("x"))).alias(f"p{p}") for p in percentiles]
    aggs += [(F.sum(F.col("x") * kept(a / 100.0)) / F.sum(kept(a / 100.0))).alias(f"trim{a:02d}") for a in trims]
    aggs += [F.sum(F.when(F.col("x") > t, F.col("_s") * 100).otherwise(0.0)).alias(f"share_gt{t}") for t in above]
    aggs += [F.sum(F.when(F.col("x") < 0, F.col("_s") * 100).otherwise(0.0)).alias("share_lt0")]
    out = scored.groupBy(*group).agg(*aggs)
    out = out.filter((F.col("n") >= min_items) & (F.col("covered") >= min_weight))
    return out.select(
        *group,
        "n",
        "covered",
        "wmean",
        F.sqrt("_m2").alias("sd"),
        F.when(F.col("_m2") > 0, F.col("_m3") / F.pow("_m2", F.lit(1.5))).alias("skew"),
        F.when(F.col("_m2") > 0, F.col("_m4") / F.pow("_m2", F.lit(2)) - 3).alias("exkurt"),
        *[f"p{p}" for p in percentiles],
        *[f"trim{a:02d}" for a in trims],
        *[f"share_gt{t}" for t in above],
        "share_lt0",
    )


def with_universes(df: DataFrame, excluded: Column, narrow: str = "ex") -> DataFrame:
    """Each row once in universe 'all' and, unless excluded, once in the narrow one."""
    return df.withColumn("universe", F.explode(F.when(excluded, F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit(narrow)))))


def contribution_panel(df: DataFrame, month: str, x: str, w: str, min_weight: float = 60.0) -> DataFrame:
    """c = renormalised weight * x, dropping months whose covered weight is thin."""
    rows = df.filter(F.col(x).isNotNull() & (F.col(w) > 0))
    with_cover = with_group_totals(rows, month, covered=F.sum(w)).filter(F.col("covered") >= min_weight)
    return with_cover.withColumn("c", F.col(w) / F.col("covered") * F.col(x))


def variance_shares(contrib: DataFrame, item: str, month: str, windows=(24, 60), min_frac: float = 0.9) -> DataFrame:
    """Cov(c_i, X) / Var(X) over trailing windows; a missing item counts as 0, shares sum to 1.

    The frame runs inside one item over the months that exist, so it is bounded
    by the calendar.
    """
    months = contrib.groupBy(month).agg(F.sum("c").alias("X"))
    span = months.agg(F.min(month).alias("_first"), F.max(month).alias("_last"))
    grid = with_one_row(contrib.select(item).distinct(), span).select(item, "_first", F.explode(F.sequence("_first", "_last")).alias(month))
    dense = (
        grid.join(months, month)
        .join(contrib.select(item, month, "c"), [item, month], "left")
        .withColumn("_c0", F.coalesce("c", F.lit(0.0)))
    )
    per_window = []
    for length in windows:
        frame = trailing(item, month, -(length - 1))
        per_window.append(
            F.struct(
                F.lit(length).alias("window"),
                F.count("X").over(frame).alias("n_months"),
                F.var_pop("X").over(frame).alias("v"),
                F.covar_pop("_c0", "X").over(frame).alias("cov"),
            )
        )
    rows = dense.select(item, month, "c", "_first", F.array(*per_window).alias("_w")).select(item, month, "c", "_first", F.inline("_w"))
    kept = (F.col("n_months") >= min_frac * F.col("window")) & (F.col("v") > 0) & (F.col(month) - F.col("_first") >= F.col("window") - 1)
    shares = rows.filter(kept).select(item, month, "window", "n_months", (F.col("cov") / F.col("v")).alias("share"), "c")
    return shares.filter(F.abs("share") > 1e-12)


def compound_trailing(df: DataFrame, by: str, month: str, x: str, span: int = 12, min_months: int = 10) -> DataFrame:
    """Annual rate from monthly percent changes; with holes, the months present are annualised geometrically."""
    frame = trailing(by, month, -(span - 1))
    return (
        df.withColumn("n_months", F.count(x).over(frame))
        .withColumn("_log", F.sum(F.log1p(F.col(x) / 100)).over(frame))
        .withColumn(
            "compound", F.when(F.col("n_months") >= min_months, (F.exp(F.col("_log") * (F.lit(float(span)) / F.col("n_months"))) - 1) * 100)
        )
        .drop("_log")
    )


def rank_percentile(df: DataFrame, group, value: str, name: str = "pct_rank") -> DataFrame:
    """(average rank - 0.5) / n within the group."""
    ranked = with_ranks(df, group, value)
    return ranked.withColumn(name, (F.col("rank_mean") - 0.5) / F.col("group_n")).drop("rank_low", "rank_mean", "rank_high")


def weighted_median(df: DataFrame, group, value: str, weight: str, name: str = "wmedian") -> DataFrame:
    group = [group] if isinstance(group, str) else list(group)
    rows = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    run = running_totals(rows, group, value, weight)
    reached = F.col(f"{weight}_run") / F.col(f"{weight}_total") >= 0.5
    return run.groupBy(*group).agg(F.min(F.when(reached, F.col(value))).alias(name))


def expanding_percentile(df: DataFrame, by, ordinal: str, value: str, min_points: int = 12, name: str = "hist_pct") -> DataFrame:
    """Percent of own history up to and including now that is at or below the value.

    Counting is by dominance: the first q points of a series are one block of 2^k
    adjacent points for every bit k of q, a point is a member of one block a level,
    and its rank inside a block comes from running counts over value buckets.  A
    row so becomes about 1.5 log2(n) small ones; no history is gathered, and a
    series of any length is spread over its blocks and buckets.
    """
    by = [by] if isinstance(by, str) else list(by)
    known = df.filter(F.col(value).isNotNull()).select(*by, ordinal, value)
    placed = with_position(known, by, ordinal, value, "_at").join(value_ranks(known, by, ordinal).select(*by, ordinal, F.col("rank_high").alias("_q")), [*by, ordinal])
    placed = placed.select(*by, ordinal, value, (F.col("_at") - 1).alias("_at"), "_q", "group_n")
    level = F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("group_n").cast("double"))).cast("int")))
    members = placed.select(*by, value, "_at", level.alias("_k")).select(*by, value, "_k", F.expr("shiftright(_at, _k)").alias("_block"), F.lit(1).alias("_one"))
    asked = placed.select(*by, ordinal, value, "_q", level.alias("_k")).filter(F.expr("shiftright(_q, _k) & 1 = 1"))
    asked = asked.select(*by, ordinal, value, "_k", (F.expr("shiftright(_q, _k)") - 1).alias("_block")).distinct()
    cells = members.unionByName(asked.select(*by, value, "_k", "_block", F.lit(0).alias("_one")))
    ranked = running_totals(cells, [*by, "_k", "_block"], value, "_one").select(*by, "_k", "_block", value, "_one_run")
    below = asked.join(ranked, [*by, "_k", "_block", value]).groupBy(*by, ordinal, value).agg(F.sum("_one_run").alias("_below"))
    sizes = placed.select(*by, ordinal, value, "_q").distinct()
    found = below.join(sizes, [*by, ordinal, value])
    found = found.select(*by, ordinal, value, F.when(F.col("_q") >= min_points, F.col("_below") * 100.0 / F.col("_q")).alias(name))
    return df.join(found, [*by, ordinal, value], "left").select(*df.columns, name)


def spearman(df: DataFrame, group, x: str, y: str, min_n: int = 5) -> DataFrame:
    """Rank correlation with average ranks over pairs where both sides exist."""
    group = [group] if isinstance(group, str) else list(group)
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = with_ranks(pairs, group, x).withColumnRenamed("rank_mean", "_rx").drop("rank_low", "rank_high", "group_n")
    both = with_ranks(rx, group, y)
    out = both.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), pair_corr("_rx", "rank_mean").alias("rho"))
    return out.select(*group, "n", F.when(F.col("n") >= min_n, F.col("rho")).alias("rho"))


def coverage_gate(df: DataFrame, month, flag: Column, weight: str, min_share: float = 0.9) -> DataFrame:
    """Rows of months where the flagged part carries at least ``min_share`` of the weight."""
    month = [month] if isinstance(month, str) else list(month)
    good = df.groupBy(*month).agg(
        F.sum(F.when(flag, F.col(weight)).otherwise(0.0)).alias("_a"), F.sum(weight).alias("_b")
    ).filter(F.col("_a") >= min_share * F.col("_b"))
    return df.join(good.select(*month), month, "left_semi")

"""Exact order statistics for groups of any size.

A window over one whole group would run in one task, and Spark's exact
``percentile`` keeps a group's distinct values in one buffer.  Here a group is
cut by ``order_bucket``: a fixed, monotone log-linear function of the value, so
the number of buckets in a group is bounded by the number of binades times
``2**bits`` whatever the row count.  Counts per (group, value) are combined
before the shuffle, running totals go over buckets first, and only then inside
a bucket.  The bucket function depends on nothing but the value, so a re-run
task always makes the same cut.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.session import scratch_folder


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def order_bucket(value, bits: int = 12) -> Column:
    """Monotone BIGINT bucket of a number: binade and ``bits`` leading fraction bits.

    Values far from zero but close together, such as times, should come as the
    distance from their group's smallest one.
    """
    x = _c(value).cast("double")
    a = F.abs(x)
    steps = 1 << bits
    e = F.floor(F.log2(a))
    frac = F.floor((a / F.pow(F.lit(2.0), e) - 1) * steps)
    key = (e + 1100) * steps + F.greatest(F.lit(0), F.least(frac, F.lit(steps - 1))) + 1
    return F.when(x == 0, F.lit(0)).when(x > 0, key).otherwise(-key).cast("bigint")


def with_group_totals(df: DataFrame, keys, **aggs: Column) -> DataFrame:
    """Group aggregates joined back to the rows.

    Used instead of a window over the group: the aggregate is combined on the
    map side and its result is joined, so a hot group is never one task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    totals = df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])
    return df.join(totals, keys)


def running_totals(df: DataFrame, group, value: str, measures, bits: int = 12) -> DataFrame:
    """Inclusive running sums of ``measures`` in ascending ``value`` order, plus group totals.

    Rows are first summed per (group, value): ties share one row.  Adds
    ``<m>_run`` and ``<m>_total`` for every measure.
    """
    group = [group] if isinstance(group, str) else list(group)
    measures = [measures] if isinstance(measures, str) else list(measures)
    cells = (
        df.groupBy(*group, value)
        .agg(*[F.sum(m).alias(m) for m in measures])
        .withColumn("_bucket", order_bucket(value, bits))
    )
    up_to = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    heads = cells.groupBy(*group, "_bucket").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    heads = heads.select(
        *group,
        "_bucket",
        *[(F.sum(f"_{m}").over(up_to) - F.col(f"_{m}")).alias(f"_{m}_before") for m in measures],
        *[F.sum(f"_{m}").over(whole).alias(f"{m}_total") for m in measures],
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = cells.join(heads, [*group, "_bucket"])
    return out.select(
        *group,
        value,
        *measures,
        *[(F.col(f"_{m}_before") + F.sum(m).over(inside)).alias(f"{m}_run") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def exact_quantiles(df: DataFrame, group, value: str, stats: dict[str, float], method: str = "inclusive", bits: int = 12) -> DataFrame:
    """Exact quantiles per group: one column per entry of ``stats`` plus ``n``.

    ``inclusive`` interpolates at p*(n-1), ``exclusive`` at p*(n+1) with the
    rank kept inside 1..n-1, ``upper`` takes the element at floor(p*n).  NULL
    values are left out; only buckets that hold a wanted rank are opened.
    """
    group = [group] if isinstance(group, str) else list(group)
    keys = group or ["_all"]
    src = df.filter(F.col(value).isNotNull())
    src = src.select(*group, F.col(value).cast("double").alias("_v")) if group else src.select(
        F.lit(1).alias("_all"), F.col(value).cast("double").alias("_v")
    )
    cells = src.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", order_bucket("_v", bits))
    up_to = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    heads = (
        cells.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_before", F.sum("_bn").over(up_to) - F.col("_bn"))
        .withColumn("n", F.sum("_bn").over(Window.partitionBy(*keys)))
    )
    ranks = F.array(*[_rank_struct(name, p, F.col("n"), method) for name, p in stats.items()])
    wanted = (
        heads.withColumn("_s", F.explode(ranks))
        .select(*keys, "_bucket", "_before", "n", "_bn", "_s.*")
        .withColumn("_side", F.explode(F.array(F.struct(F.col("lo").alias("r"), (1 - F.col("frac")).alias("w")),
                                               F.struct(F.col("hi").alias("r"), F.col("frac").alias("w")))))
        .select(*keys, "_bucket", "_before", "n", "_bn", "stat", F.col("_side.r").alias("_r"), F.col("_side.w").alias("_w"))
        .filter((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_bn")))
        .groupBy(*keys, "_bucket", "_before", "n")
        .agg(F.collect_list(F.struct("stat", "_r", "_w")).alias("_picks"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        cells.join(wanted, [*keys, "_bucket"])
        .withColumn("_run", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_p", F.explode("_picks"))
        .filter((F.col("_p._r") < F.col("_run")) & (F.col("_p._r") >= F.col("_run") - F.col("_n")))
    )
    out = rows.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.sum(F.when(F.col("_p.stat") == name, F.col("_v") * F.col("_p._w"))).alias(name) for name in stats],
    )
    return out.select(*group, "n", *stats)


def _rank_struct(name: str, p: float, n: Column, method: str) -> Column:
    """0-based lower and upper rank and the weight of the upper one."""
    if method == "inclusive":
        h = F.lit(p) * (n - 1)
        lo = F.floor(h)
        hi = F.least(lo + 1, n - 1)
        frac = h - lo
    elif method == "exclusive":
        h = F.lit(p) * (n + 1)
        j = F.greatest(F.lit(1), F.least(F.floor(h), n - 1))
        lo, hi, frac = F.least(j - 1, n - 1), F.least(j, n - 1), h - j
    elif method == "upper":
        lo = F.least(F.floor(F.lit(p) * n), n - 1)
        hi, frac = lo, F.lit(0.0)
    else:
        raise ValueError(f"unknown quantile method {method}")
    return F.struct(
        F.lit(name).alias("stat"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), frac.cast("double").alias("frac")
    )


def value_ranks(df: DataFrame, group, value: str, bits: int = 12) -> DataFrame:
    """Per distinct value of a group: lowest, mean and highest 1-based rank, and the group size."""
    group = [group] if isinstance(group, str) else list(group)
    counted = running_totals(
        df.filter(F.col(value).isNotNull()).select(*group, value, F.lit(1).cast("bigint").alias("n")), group, value, "n", bits
    )
    return counted.select(
        *group,
        value,
        (F.col("n_run") - F.col("n") + 1).alias("rank_low"),
        (F.col("n_run") - (F.col("n") - 1) / 2).cast("double").alias("rank_mean"),
        F.col("n_run").alias("rank_high"),
        F.col("n_total").alias("group_n"),
    )


def with_ranks(df: DataFrame, group, value: str, bits: int = 12) -> DataFrame:
    """``value_ranks`` joined back to the rows."""
    group = [group] if isinstance(group, str) else list(group)
    return df.join(value_ranks(df, group, value, bits), [*group, value])


def with_position(df: DataFrame, group, value: str, tie: str, name: str = "position", bits: int = 16) -> DataFrame:
    """1-based position by (value, tie) for a numeric tie key, without one task per group or per tied value."""
    group = [group] if isinstance(group, str) else list(group)
    rows = df.withColumn("_tie_bucket", order_bucket(tie, bits))
    values = value_ranks(df, group, value, bits).select(*group, value, (F.col("rank_low") - 1).alias("_value_before"), "group_n")
    by_value = Window.partitionBy(*group, value).orderBy("_tie_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ties = rows.groupBy(*group, value, "_tie_bucket").agg(F.count(F.lit(1)).alias("_tn"))
    ties = ties.withColumn("_tie_before", F.sum("_tn").over(by_value) - F.col("_tn")).drop("_tn")
    local = F.row_number().over(Window.partitionBy(*group, value, "_tie_bucket").orderBy(tie))
    return (
        rows.join(ties, [*group, value, "_tie_bucket"])
        .join(values, [*group, value])
        .withColumn(name, F.col("_value_before") + F.col("_tie_before") + local)
        .drop("_tie_bucket", "_tie_before", "_value_before")
    )


def with_prior_max(df: DataFrame, group, order: str, value: str, name: str = "prior_max", bits: int = 26) -> DataFrame:
    """Largest value of the group's earlier rows, NULL on the first one; ``order`` is numeric and unique inside the group.

    Maxima go over order buckets first and inside a bucket second, so a long or
    hot series is spread over many tasks.
    """
    group = [group] if isinstance(group, str) else list(group)
    rows = df.withColumn("_bucket", order_bucket(order, bits))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(*group, "_bucket").agg(F.max(value).alias("_m")).withColumn("_before", F.max("_m").over(earlier)).drop("_m")
    inside = Window.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(heads, [*group, "_bucket"])
    return joined.withColumn(name, F.greatest(F.max(value).over(inside), "_before")).drop("_bucket", "_before")


def top_k(df: DataFrame, group, order, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group in a total order.

    The filter on ``row_number`` lets Spark keep only k rows per group and task
    before the shuffle, so a hot group sends tasks x k rows, not all of them.
    """
    group = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate, which has exactly one row by construction."""
    return df.join(F.broadcast(one_row.limit(1)), F.lit(True))


def shared(df: DataFrame) -> DataFrame:
    """Keep a derived table that several branches of a job read; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def written(df: DataFrame) -> DataFrame:
    """Write a derived table to the session's shared folder as Parquet and go on from the files.

    For panel-sized results that several later steps read: the lineage is cut,
    so a lost executor never sends the job back to the raw tables, and readers
    prune columns.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the keys into the session's full number of shuffle partitions.

    For grouped numpy work: small inputs would otherwise be merged into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

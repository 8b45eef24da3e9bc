"""Cross-source checks: ratios, reconciliations, drift, validation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.ordered import exact_quantiles, top_k

# Tolerances the ratio summaries report.
WITHIN = (5, 10, 20, 25)


def ratio_summary(df: DataFrame, group, ratio: str) -> DataFrame:
    """n, exact matches, median, exclusive quartiles and percent within 5/10/20/25% of 1."""
    group = [group] if isinstance(group, str) else list(group)
    rows = df.filter(F.col(ratio).isNotNull() & (F.col(ratio) != 0))
    counts = rows.groupBy(*group).agg(
        F.count_if(F.col(ratio) == 1).alias("exact"),
        *[(F.avg((F.abs(F.col(ratio) - 1) <= w / 100).cast("double")) * 100).alias(f"within{w}") for w in WITHIN],
    )
    quart = exact_quantiles(rows, group, ratio, {"q1": 0.25, "median": 0.5, "q3": 0.75}, "exclusive")
    return quart.join(counts, group)


def closest_year(left: DataFrame, right: DataFrame, keys: list[str], year: str, ours: str, theirs: str, offsets=(0, 1)) -> DataFrame:
    """Ratio to the same or a neighbouring year of the other source, keeping the one nearest to 1.

    Each right row is offered to the few candidate years it may match, so the
    join stays an equality join.
    """
    offered = right.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("_year", F.col(year) - F.col("offset"))
    offered = offered.select(*keys, F.col("_year").alias(year), "offset", theirs)
    joined = left.join(offered, [*keys, year]).filter(F.col(theirs) != 0)
    ratio = F.col(ours) / F.col(theirs)
    return joined.groupBy(*keys, year).agg(F.min(F.struct(F.abs(ratio - 1).alias("d"), F.col("offset"), ratio.alias("ratio"))).alias("_b")).select(
        *keys, year, F.col("_b.offset").alias("offset"), F.col("_b.ratio").alias("ratio")
    )


def prefer_ours(ours: DataFrame, theirs: DataFrame, keys: list[str], universe: DataFrame, unit: str) -> DataFrame:
    """Own rows plus the other source's rows for keys we lack, inside the universe; source tagged."""
    a = ours.join(universe, unit, "left_semi").withColumn("source", F.lit("own"))
    b = theirs.join(universe, unit, "left_semi").join(ours.select(*keys), keys, "left_anti").withColumn("source", F.lit("external"))
    return a.unionByName(b)


def reconcile_levels(ours: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Exact matches per published level; published(level, *keys, amount) against ours(*keys, amount)."""
    mine = ours.withColumnRenamed("amount", "_ours")
    return (
        published.join(mine, keys, "left")
        .groupBy("level")
        .agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("amount") == F.col("_ours")).alias("hits"))
    )


def best_level(levels: DataFrame) -> DataFrame:
    return levels.agg(F.max_by("level", F.struct("hits", "level")).alias("level"), F.max("hits").alias("hits"))


def drift(old: DataFrame, new: DataFrame, keys: list[str], value: str, limit: float = 0.5) -> DataFrame:
    """Rows of both runs whose value moved by more than ``limit``."""
    a, b = old.withColumnRenamed(value, "before"), new.withColumnRenamed(value, "after")
    return a.join(b, keys).withColumn("moved", F.col("after") - F.col("before")).filter(F.abs("moved") > limit)


def worse_headlines(before: DataFrame, after: DataFrame, tolerance: float = 0.5, tolerant: tuple[str, ...] = ("within", "matching")) -> DataFrame:
    """Headline figures (stat, value) that fell below their baseline; names with a ``tolerant`` word may fall by ``tolerance``."""
    slack = F.when(F.col("stat").rlike("|".join(tolerant)), tolerance).otherwise(0.0)
    both = after.select("stat", F.col("value").alias("after")).join(before.select("stat", F.col("value").alias("before")), "stat")
    return both.filter(F.col("after") < F.col("before") - slack).select("stat", "before", "after")


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most common value per key, smallest value on ties, with how many rows disagree."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(
        F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("top"), (F.sum("_n") - F.max("_n")).alias("disagree")
    )


def first_accepted(df: DataFrame, key: str, accepted: Column, order: list) -> DataFrame:
    """First accepted row per key in a total order."""
    return top_k(df.filter(accepted), key, order, 1).drop("rank")


def resolve_names(names: DataFrame, items: DataFrame, matched_parents: DataFrame) -> DataFrame:
    """One code per name: prefer a code whose parent is already matched, else the first code.

    names(name), items(name, code, parent), matched_parents(code).
    """
    known = matched_parents.select(F.col("code").alias("parent")).distinct().withColumn("_known", F.lit(True))
    cand = names.join(items, "name").join(known, "parent", "left")
    best = F.min(F.struct(F.when(F.col("_known"), 0).otherwise(1).alias("p"), F.col("code").alias("code")))
    return cand.groupBy("name").agg(best.alias("_b"), F.count(F.lit(1)).alias("candidates")).select(
        "name", F.col("_b.code").alias("code"), (F.col("_b.p") == 0).alias("parent_matched"), "candidates"
    )


def check_rows(df: DataFrame, name: str, key: Column, ours: str, published: str, tolerance: float) -> DataFrame:
    """Validation-log rows: check_name, key, ours, published, diff, ok."""
    diff = F.col(ours) - F.col(published)
    return df.select(
        F.lit(name).alias("check_name"), key.alias("key"), F.col(ours).alias("ours"), F.col(published).alias("published"), diff.alias("diff"), (F.abs(diff) <= tolerance).alias("ok")
    )


def figure_drift(bindings: DataFrame, live: DataFrame) -> DataFrame:
    """bindings(name, shown text, tolerance or NULL) against live(name, value): equal at the shown rounding, or within tolerance."""
    decimals = F.length(F.regexp_extract("shown", r"\.(\d+)$", 1))
    joined = bindings.join(live, "name", "left")
    # whole last-place units: the shown figure stands for the half-open step around it
    step = F.pow(F.lit(10.0), -decimals)
    gap = F.abs(F.col("value") - F.regexp_replace("shown", ",", "").try_cast("double"))
    ok = F.when(F.col("tolerance").isNull(), gap <= step / 2).otherwise(gap <= F.col("tolerance"))
    return joined.select("name", "shown", "value", F.coalesce(ok, F.lit(False)).alias("ok"))


def strip_columns(df: DataFrame, restricted: list[str]) -> DataFrame:
    """Drop restricted columns and refuse to go on if any is left under another case."""
    out = df.drop(*restricted)
    left = {c.lower() for c in out.columns} & {r.lower() for r in restricted}
    if left:
        raise ValueError(f"restricted columns still present: {sorted(left)}")
    return out


def require_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df


def changed_sources(current: DataFrame, state: DataFrame) -> DataFrame:
    """current(source, fingerprint, seen, failed) against state(source, fingerprint, changed).

    A new or different fingerprint takes the date seen; a failed poll carries
    the stored state forward.
    """
    old = state.select("source", F.col("fingerprint").alias("_fp"), F.col("changed").alias("_changed"))
    joined = current.join(old, "source", "full_outer")
    failed = F.coalesce("failed", F.lit(True))
    moved = ~failed & ~F.col("fingerprint").eqNullSafe(F.col("_fp"))
    return joined.select(
        "source",
        F.when(failed, F.col("_fp")).otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(moved, F.col("seen")).otherwise(F.col("_changed")).alias("changed"),
        moved.alias("is_changed"),
    )

"""Event walls: normalised items, upserts by id, ordering and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.streaming.series import epoch_us, keep_last


def normalise_events(df: DataFrame, ident: Column, at: Column, title: Column, severity: Column, url: Column, meta: Column, now: Column, max_age_hours: int | None = None, title_length: int = 200) -> DataFrame:
    """Feed rows to {id, at, title, severity, url, meta}; old items dropped, titles clamped."""
    out = df.select(ident.alias("id"), at.alias("at"), F.substring(title, 1, title_length).alias("title"), severity.alias("severity"), url.alias("url"), meta.alias("meta"))
    if max_age_hours is not None:
        out = out.filter(epoch_us(now) - epoch_us("at") <= max_age_hours * 3_600_000_000)
    return out


def upsert_wall(state: DataFrame | None, batch: DataFrame, now: Column, history: int, forward: bool = False) -> DataFrame:
    """Newest version of each item, soonest first on forward walls and newest first otherwise.

    Items without an id are keyed by 'at|title' (200 characters); a forward wall
    drops items more than an hour past.  Rows are (wall, id, at, title, severity, fetched).
    """
    rows = batch if state is None else batch.unionByName(state.select(*batch.columns))
    # the clamp applies to the fallback key only; titles are kept whole
    keyed = rows.withColumn("id", F.coalesce("id", F.substring(F.concat_ws("|", F.col("at").cast("string"), "title"), 1, 200)))
    rest = [c for c in keyed.columns if c not in ("wall", "id")]
    latest = keyed.groupBy("wall", "id").agg(F.max_by(F.struct(*rest), F.struct("fetched", "at", "title")).alias("_r")).select("wall", "id", "_r.*")
    latest = latest.filter(F.col("at").isNotNull())
    if forward:
        latest = latest.filter(epoch_us("at") >= epoch_us(now) - 3_600_000_000)
    # a unique order inside a wall: time in microseconds, then the id
    return keep_last(latest.withColumn("_o", epoch_us("at")), "wall", "_o", history, newest=not forward, tie="id").drop("_o")


def severity_by_pattern(text, rules: list[tuple[str, str]], default: str = "info") -> Column:
    """Level of the first pattern found."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    out = None
    for pattern, level in rules:
        out = F.when(c.rlike(pattern), level) if out is None else out.when(c.rlike(pattern), level)
    return out.otherwise(default)


def severity_by_class(text) -> Column:
    """Class letter and size: X serious, critical from X10; M warning, serious from M5; otherwise info."""
    c = F.upper(F.col(text) if isinstance(text, str) else text)
    letter, size = F.substring(c, 1, 1), F.regexp_extract(c, r"^[A-Z](\d+(?:\.\d+)?)", 1).try_cast("double")
    x = F.when(size >= 10, "critical").otherwise("serious")
    m = F.when(size >= 5, "serious").otherwise("warning")
    return F.when(letter == "X", x).when(letter == "M", m).otherwise("info")


def severity_by_enum(value, mapping: dict[str, str], default: str = "info") -> Column:
    c = F.col(value) if isinstance(value, str) else value
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def run_log(runs: DataFrame, cap: int = 20) -> DataFrame:
    """Newest runs first, capped: a report of the last ``cap`` rows."""
    return runs.orderBy(F.desc("run_at"), "id").limit(cap)

import datetime as dt

from pyspark.sql import functions as F

from statloom.sources import feed_registry
from statloom.streaming import series, walls, windows

T0 = dt.datetime(2024, 1, 1)


def points(n, start=0, value=1.0, fetched=0, ident="a"):
    return [(ident, T0 + dt.timedelta(minutes=start + i), value + i, T0 + dt.timedelta(hours=fetched)) for i in range(n)]


SCHEMA = "id string, ts timestamp, value double, fetched timestamp"


def as_set(df):
    return sorted((r.id, r.ts, r.value) for r in df.collect())


def test_merge_keeps_newest_value_and_history(spark):
    old = spark.createDataFrame(points(5) + [("a", T0, None, T0), ("a", T0 + dt.timedelta(minutes=1), float("nan"), T0 + dt.timedelta(hours=9))], SCHEMA)
    new = spark.createDataFrame(points(3, start=3, value=100.0, fetched=1), SCHEMA)
    state = series.merge_series(None, old, 4)
    got = series.merge_series(state, new, 4)
    assert [v for _, _, v in as_set(got)] == [3.0, 100.0, 101.0, 102.0]
    snap = series.snapshot(got).collect()[0]
    assert (snap.value, snap.delta, snap.min, snap.max, snap.n) == (102.0, 1.0, 3.0, 102.0, 4)
    assert [v for _, _, v in as_set(series.merge_series(state, new, 4, replace=True))] == [100.0, 101.0, 102.0]


def test_wall_ties_are_cut_by_id(spark):
    rows = [("w", f"{i:03d}", T0, f"t{i}", "info", T0) for i in range(60)]
    df = spark.createDataFrame(rows, "wall string, id string, at timestamp, title string, severity string, fetched timestamp")
    for parts in (1, 7):
        kept = walls.upsert_wall(None, df.repartition(parts), F.lit(T0), 5)
        assert sorted(r.id for r in kept.collect()) == [f"{i:03d}" for i in range(5)]


def test_walls(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    h = lambda x: T0 + dt.timedelta(hours=x)
    rows = [("w", "1", h(9), "old", "info", h(0)), ("w", "1", h(13), "moved", "info", h(1)), ("w", None, h(14), "no id", "info", h(0)), ("w", "3", h(11.5), "recent", "info", h(0)), ("w", "4", None, "undated", "info", h(0))]
    df = spark.createDataFrame(rows, "wall string, id string, at timestamp, title string, severity string, fetched timestamp")
    titles = lambda d: [r.title for r in d.orderBy("at").collect()]
    assert titles(walls.upsert_wall(None, df, now, 10)) == ["recent", "moved", "no id"]
    assert titles(walls.upsert_wall(None, df, now, 2)) == ["moved", "no id"]
    assert titles(walls.upsert_wall(None, df, now, 2, forward=True)) == ["recent", "moved"]


def test_ladder(spark):
    reg = {r.id: r.rules for r in feed_registry.registry(spark).collect()}
    assert len(reg) == 89
    cases = [("gb-frequency", 50.6, "critical"), ("gb-frequency", 49.85, "warning"), ("gb-frequency", 50.0, "good"), ("gb-frequency", None, "unknown"), ("npm-downloads", 5.0, "unknown"), ("solar-wind-bz", -25.0, "serious")]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "n int, id string, value double").join(feed_registry.registry(spark), "id")
    got = {r.n: r.level for r in df.select("n", series.ladder("value", "rules").alias("level")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_incomplete_tail_is_cut_repeatedly(spark):
    rows = [("k", 1, 100), ("k", 2, 50), ("k", 3, 100), ("k", 4, 70), ("k", 5, 40)]
    got = windows.drop_incomplete_tail(spark.createDataFrame(rows, "k string, wk int, n int"), "k", "wk", "n")
    assert sorted(r.wk for r in got.collect()) == [1, 2, 3]


def test_unknown_counts_only_when_alone(spark):
    df = spark.createDataFrame([("s1", "unknown"), ("s1", "good"), ("s2", "unknown")], "section string, effective string")
    got = {r.section: r.level for r in series.worst_levels(df).collect()}
    assert got == {"s1": "good", "s2": "unknown", None: "good"}

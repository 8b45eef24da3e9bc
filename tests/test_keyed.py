"""Streams with keyed state and timers against the batch operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_feeds import SCHEMA, T0, as_set, points

from statloom.streaming import keyed, series, walls

WALL = "wall bigint, id string, at timestamp, title string, severity string, fetched timestamp"
RESULTS = "id string, value double, at timestamp, error string, fetched timestamp"


def hours(x):
    return T0 + dt.timedelta(hours=x)


class Source:
    """A folder of Parquet parts read as a stream, a part a trigger."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.parts = spark, path, schema, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(self.path / f"in/part={self.parts}"))
        self.parts += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in/*"))

    def run(self, changes):
        return keyed.run(changes, str(self.path / "out"), str(self.path / "ck"))

    def all(self):
        return self.spark.read.schema(self.schema).parquet(str(self.path / "in/*"))


def test_series_state_equals_the_batch_merge(spark, tmp_path):
    source = Source(spark, tmp_path, SCHEMA)
    source.add(points(40) + [("a", None, 1.0, T0), ("a", hours(1), None, T0), ("a", hours(1), float("nan"), T0)])
    source.add(points(40, start=20, value=500.0, fetched=2) + points(10, start=-30, value=9.0, fetched=3, ident="b"))
    log = source.run(keyed.series_changes(source.stream(), 25))
    assert as_set(keyed.series_points(log)) == as_set(series.merge_series(None, source.all(), 25))
    # a restart with nothing new leaves the log as it is
    assert source.run(keyed.series_changes(source.stream(), 25)).count() == log.count()
    # an earlier fetch and a time before the kept ones change nothing, a late point in between does
    source.add(points(3, start=50, value=-1.0, fetched=1) + points(1, start=-500, fetched=9) + [("a", T0 + dt.timedelta(minutes=45, seconds=30), 77.0, hours(4))])
    before = log.count()
    log = source.run(keyed.series_changes(source.stream(), 25))
    assert as_set(keyed.series_points(log)) == as_set(series.merge_series(None, source.all(), 25))
    assert log.count() == before + 2  # the late point, and the one it pushed out; b is not written again
    assert {r.id for r in log.filter("version = 3").collect()} == {"a"}


def test_a_trigger_replaces_the_points_of_its_ids(spark, tmp_path):
    source = Source(spark, tmp_path, SCHEMA)
    source.add(points(5) + points(2, ident="b"))
    source.add(points(2, start=2, value=50.0, fetched=1))
    log = source.run(keyed.series_changes(source.stream(), 10, replace=True))
    first = series.merge_series(None, spark.createDataFrame(points(5) + points(2, ident="b"), SCHEMA), 10)
    want = series.merge_series(first, spark.createDataFrame(points(2, start=2, value=50.0, fetched=1), SCHEMA), 10, replace=True)
    assert as_set(keyed.series_points(log)) == as_set(want)


def test_last_good_value_survives_failures(spark, tmp_path):
    source = Source(spark, tmp_path, RESULTS)
    source.add([("a", 1.0, hours(0), None, hours(0)), ("b", None, None, "down", hours(0)), ("c", 5.0, hours(0), None, hours(0))])
    source.add([("a", None, None, "timeout", hours(1)), ("a", None, None, "still", hours(2)), ("b", 2.0, hours(2), None, hours(2))])
    log = source.run(keyed.last_good_changes(source.stream()))
    got = {r.id: (r.value, r.last_error, r.error_count) for r in keyed.latest(log, ["id"]).collect()}
    assert got == {"a": (1.0, "still", 2), "b": (2.0, None, 0), "c": (5.0, None, 0)}
    state = spark.createDataFrame([("a", 1.0, hours(0), 0)], "id string, value double, at timestamp, error_count int")
    once = spark.createDataFrame([("a", None, None, "timeout")], "id string, value double, at timestamp, error string")
    twice = series.keep_last_good(state, once)
    again = series.keep_last_good(twice.drop("last_error"), spark.createDataFrame([("a", None, None, "still")], once.schema)).collect()[0]
    assert (again.value, again.last_error, again.error_count) == got["a"]


def wall_of(source, now, history):
    rows = walls.upsert_wall(None, source.all(), F.lit(now).cast("timestamp"), history, forward=True)
    return sorted((r.wall, r.id, r.at, r.title, r.fetched) for r in rows.collect())


def streamed_wall(source, history, lateness="0 seconds"):
    log = source.run(keyed.forward_wall_changes(source.stream(), lateness))
    return log, sorted((r.wall, r.id, r.at, r.title, r.fetched) for r in keyed.forward_wall(log, history).collect())


def test_forward_wall_items_leave_by_time_alone(spark, tmp_path):
    source = Source(spark, tmp_path, WALL)
    source.add([(1, "x", hours(5), "soon", "info", hours(0)), (1, "y", hours(9), "later", "info", hours(0)), (1, None, hours(7), "no id", "info", hours(0)), (2, "z", hours(30), "far", "info", hours(0))])
    source.add([(1, "y", hours(3), "moved", "info", hours(1)), (1, "u", None, "undated", "info", hours(1))])
    _, got = streamed_wall(source, 10)
    assert got == wall_of(source, hours(1), 10) and [r[1] for r in got if r[0] == 1].count("y") == 1
    # only wall 2 has a new row, but time goes on: x and y are an hour past, the item without id is just one hour old
    source.add([(2, "w", hours(40), "new", "info", hours(8))])
    log, got = streamed_wall(source, 10)
    assert got == wall_of(source, hours(8), 10) and [r[3] for r in got] == ["no id", "new", "far"]
    assert {r.id for r in log.filter("NOT kept").collect()} == {"x", "y"}
    assert streamed_wall(source, 1)[1] == wall_of(source, hours(8), 1)


def test_an_older_version_does_not_bring_a_past_item_back(spark, tmp_path):
    source = Source(spark, tmp_path, WALL)
    source.add([(1, "x", hours(0.5), "over", "info", hours(6)), (1, "v", None, "undated", "info", hours(6))])
    source.add([(1, "x", hours(20), "older", "info", hours(5)), (1, "v", hours(20), "older", "info", hours(5))])
    _, got = streamed_wall(source, 10, "4 hours")
    assert got == wall_of(source, hours(2), 10) == []
    source.add([(1, "x", hours(21), "newer", "info", hours(7))])
    assert [r[3] for r in streamed_wall(source, 10, "4 hours")[1]] == ["newer"]


def test_a_silent_feed_turns_stale_without_a_row_of_its_own(spark, tmp_path):
    schema = "id string, at timestamp"
    source = Source(spark, tmp_path, schema)
    changes = lambda: keyed.staleness_changes(source.stream(), F.when(F.col("id") == "slow", 20 * 3_600_000).otherwise(2 * 3_600_000), "0 seconds")
    stale = lambda log: {r.id: r.stale for r in keyed.latest(log, ["id"]).collect()}
    source.add([("a", hours(0)), ("b", hours(1)), ("slow", hours(0))])
    assert stale(source.run(changes())) == {"a": False, "b": False, "slow": False}
    source.add([("b", hours(2))])
    assert stale(source.run(changes()))["a"] is False  # exactly the window is not yet stale
    source.add([("b", hours(3))])
    log = source.run(changes())
    assert stale(log) == {"a": True, "b": False, "slow": False}
    source.add([("a", hours(3.5))])
    assert stale(source.run(changes())) == {"a": False, "b": False, "slow": False}


@pytest.mark.parametrize("us, ms", [(0, 1), (999, 1), (1000, 2)])
def test_timers_fire_behind_their_time(us, ms):
    assert keyed.due_ms(us) == ms


def test_a_bucket_of_a_wall_holds_many_items(spark, tmp_path):
    source = Source(spark, tmp_path, WALL)
    source.add([(1, f"i{i}", hours(i % 20), f"t{i}", None if i % 9 == 0 else "info", hours(0)) for i in range(300)] + [(None, "n", hours(9), "no wall", "info", hours(0))])
    source.add([(1, f"i{i}", hours(30), "moved", "info", hours(3)) for i in range(0, 300, 7)])
    changes = keyed.forward_wall_changes(source.stream(), "0 seconds", buckets=2)
    log = source.run(changes)
    entry = lambda r: (r.wall, r.id, r.at, r.title, r.fetched)
    want = walls.upsert_wall(None, source.all(), F.lit(hours(3)).cast("timestamp"), 500, forward=True)
    assert {entry(r) for r in keyed.forward_wall(log, 500).collect() if r.wall} == {entry(r) for r in want.collect() if r.wall}
    # an item's entry leaves once: every id that is not kept has one such row
    assert log.filter("NOT kept").groupBy("wall", "id").count().filter("count > 1").count() == 0

"""Feeds as keyed streaming state: every trigger touches only the keys it has rows or due timers for.

Each processor emits a change log: the changed entry, whether it is (still) there
and the key's version, which grows by one with every change of the key.  The sink
appends, so what is stored grows with the changes; ``latest`` is the state the log
describes.  Times are whole microseconds (``*_us``) inside, time stamps outside.
Where timers run, a row at or before the watermark is late and Spark drops it, so
the lateness given should cover what may come out of order.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from statloom.streaming.series import epoch_us, keep_last

HOUR_US = 3_600_000_000
NEVER = -(1 << 63)  # a missing time or wall, on the way into pandas
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession):
    """Keyed state needs the embedded store; the session's setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run(changes: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Process everything that is there, append the changes to ``folder`` and return the whole log.

    The file sink's own log makes a replayed trigger write once; a restart goes on
    from the checkpoint and returns the same log when there is nothing new.
    """
    spark = changes.sparkSession
    with keyed_store(spark):
        query = changes.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(changes.schema).parquet(folder)


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The entries that are there, each in its last version."""
    rest = [c for c in log.columns if c not in (*keys, "version")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_e")).select(*keys, "_e.*").filter("kept").drop("kept")


def due_ms(us: Column | int):
    """First millisecond after a time in microseconds, the grain of timers and watermarks."""
    return us // 1000 + 1 if isinstance(us, int) else F.floor(us / 1000) + 1


class SeriesState(StatefulProcessor):
    """Points of one series: the newest fetch of a time wins, the last ``history`` times stay.

    A trigger reads the kept points of its ids once and writes only those that
    change.  A time below the kept ones of a full series can never come back, as
    points are only added.  With ``replace`` the points of a trigger push out the
    earlier ones of their id.
    """

    SCHEMA = "id string, us bigint, value double, fetched_us bigint, kept boolean, version bigint"

    def __init__(self, history: int, replace: bool = False):
        self.history, self.replace = history, replace

    def init(self, handle) -> None:
        self.points = handle.getMapState("points", "us bigint", "fetched_us bigint, value double")
        self.version = handle.getValueState("version", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = {k[0]: (v[0], v[1]) for k, v in self.points.iterator()} if self.version.exists() else {}
        points = {} if self.replace else dict(stored)
        for row in rows:
            if row.us is None or row.value is None or math.isnan(row.value):
                continue
            new = (row.fetched_us, row.value)
            if row.us not in points or points[row.us] < new:
                points[row.us] = new
            if len(points) > 4 * self.history + 64:
                points = {us: points[us] for us in heapq.nlargest(self.history, points)}
        kept = {us: points[us] for us in heapq.nlargest(self.history, points)}
        gone, changed = stored.keys() - kept.keys(), [us for us, p in kept.items() if stored.get(us) != p]
        if not gone and not changed:
            return
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        for us in gone:
            self.points.removeKey((us,))
            yield Row(id=key[0], us=us, value=None, fetched_us=None, kept=False, version=version)
        for us in changed:
            self.points.updateValue((us,), kept[us])
            yield Row(id=key[0], us=us, value=kept[us][1], fetched_us=kept[us][0], kept=True, version=version)

    def close(self) -> None:
        pass


def series_changes(stream: DataFrame, history: int, replace: bool = False) -> DataFrame:
    """Change log of (id, ts, value, fetched); a late point merges by its time like any other."""
    rows = stream.select("id", epoch_us("ts").alias("us"), F.col("value").cast("double").alias("value"), epoch_us("fetched").alias("fetched_us"))
    return rows.groupBy("id").transformWithState(SeriesState(history, replace), SeriesState.SCHEMA, "Append", "None")


def series_points(log: DataFrame) -> DataFrame:
    """(id, ts, value, fetched) as the batch merge gives them."""
    return latest(log, ["id", "us"]).select("id", F.timestamp_micros("us").alias("ts"), "value", F.timestamp_micros("fetched_us").alias("fetched"))


class LastGood(StatefulProcessor):
    """One feed's last good value; a failed fetch adds its error and counts up, a success resets.

    The results of a feed in one trigger are taken in the order of their fetch.
    """

    SCHEMA = "id string, value double, at_us bigint, last_error string, error_count int, kept boolean, version bigint"

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "value double, at_us bigint, last_error string, error_count int, version bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        value, at, error, count, version = self.state.get() if self.state.exists() else (None, None, None, 0, 0)
        for row in sorted(rows, key=lambda r: (r.fetched_us, r.error is not None)):
            if row.error is None:
                value, at, error, count = row.value, row.at_us, None, 0
            else:
                error, count = row.error, count + 1
        self.state.update((value, at, error, count, version + 1))
        yield Row(id=key[0], value=value, at_us=at, last_error=error, error_count=count, kept=True, version=version + 1)

    def close(self) -> None:
        pass


def last_good_changes(stream: DataFrame) -> DataFrame:
    """Change log of (id, value, at, error, fetched)."""
    rows = stream.select("id", F.col("value").cast("double").alias("value"), epoch_us("at").alias("at_us"), "error", epoch_us("fetched").alias("fetched_us"))
    return rows.groupBy("id").transformWithState(LastGood(), LastGood.SCHEMA, "Append", "None")


class ForwardItems(StatefulProcessor):
    """A bucket of a forward wall's items: their newest versions, until an hour after their time has passed.

    Items leave by a timer, with or without further rows.  A version that is over
    (or undated) is remembered, unseen, until the watermark has passed its fetch:
    an older version that comes late must not bring the item back.  The bucket is
    read and written at once and has one timer, that of the item due first, so a
    trigger costs a few calls a bucket and none an item.
    """

    SCHEMA = "wall bigint, id string, at_us bigint, title string, severity string, fetched_us bigint, kept boolean, version bigint"

    def init(self, handle) -> None:
        self.handle = handle
        # an array a field: the items of a bucket are one value
        self.items = handle.getValueState(
            "items", "due bigint, id array<string>, fetched_us array<bigint>, at_us array<bigint>, title array<string>, severity array<string>, kept array<boolean>, version array<bigint>"
        )

    @staticmethod
    def _order(item) -> tuple:
        return tuple((x is not None, x if x is not None else 0) for x in item[:2]) + ((item[2] is not None, item[2] or ""),)

    @staticmethod
    def _due(item) -> int:
        """When a kept item leaves, and when one that is over is forgotten."""
        fetched, at, _, _, kept, _ = item
        if kept:
            return due_ms(at + HOUR_US)
        return max(due_ms(at + HOUR_US) if at is not None else 0, due_ms(fetched) if fetched is not None else 0)

    def _stored(self) -> tuple[dict, int | None]:
        """The items, and the timer that is set."""
        if not self.items.exists():
            return {}, None
        due, ids, *fields = self.items.get()
        return dict(zip(ids, zip(*fields, strict=True), strict=True)), due

    def _store(self, items: dict, timer: int | None) -> None:
        """Write the bucket, and move its timer (``timer``: the one that is set) to the item due first."""
        due = min(map(self._due, items.values()), default=None)
        if items:
            self.items.update((due, list(items), *map(list, zip(*items.values(), strict=True))))
        else:
            self.items.clear()
        if timer == due:
            return
        if timer is not None:
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = {}
        for frame in rows:
            fetched, at = ([None if us == NEVER else us for us in frame[c].tolist()] for c in ("fetched_us", "at_us"))
            for ident, *item in zip(frame["id"].tolist(), fetched, at, frame["title"].tolist(), frame["severity"].tolist(), strict=True):
                if ident not in came or self._order(item) > self._order(came[ident]):
                    came[ident] = item
        (items, timer), now, changed = self._stored(), max(0, timerValues.getCurrentWatermarkInMs()), []
        for ident, item in came.items():
            stored = items.get(ident)
            if stored is not None and self._order(stored) >= self._order(item):
                continue
            kept = item[1] is not None and due_ms(item[1] + HOUR_US) > now
            was, version = (stored[4], stored[5]) if stored is not None else (False, 0)
            items[ident] = (*item, kept, version + 1)
            changed.append((ident, was))
        if not changed:
            return
        self._store(items, timer)
        yield self._frame(key, [(ident, items[ident]) for ident, was in changed if items[ident][4] or was])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (items, _), now, left = self._stored(), timerValues.getCurrentWatermarkInMs(), []
        for ident, item in list(items.items()):
            if self._due(item) > now:
                continue
            over = (*item[:4], False, item[5] + 1)
            if item[4]:
                left.append((ident, over))
            if self._due(over) > now:
                items[ident] = over
            else:
                del items[ident]
        self._store(items, None)  # the timer that has expired is gone by itself
        yield self._frame(key, left)

    @staticmethod
    def _frame(key, entries: list) -> pd.DataFrame:
        # objects, so that no whole number becomes a float beside a missing one
        wall = int(key[0]) if key[0] != NEVER else None
        rows = [(wall, ident, at, title, severity, fetched, kept, version) for ident, (fetched, at, title, severity, kept, version) in entries]
        return pd.DataFrame(rows, columns=["wall", "id", "at_us", "title", "severity", "fetched_us", "kept", "version"], dtype=object)

    def close(self) -> None:
        pass


def forward_wall_changes(stream: DataFrame, lateness: str, buckets: int = 256) -> DataFrame:
    """Change log of a forward wall (wall, id, at, title, severity, fetched); now is the watermark of the fetches.

    State and timers are kept per ``buckets``-th of a wall's ids, so a wall with most
    of the items is many keys; a bucket's items, those not yet over, are read together.
    """
    keyed = stream.withColumn("id", F.coalesce("id", F.substring(F.concat_ws("|", F.col("at").cast("string"), "title"), 1, 200)))
    us = lambda c: F.coalesce(epoch_us(c), F.lit(NEVER)).alias(f"{c}_us")
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")
    rows = keyed.withWatermark("fetched", lateness).select(F.coalesce(F.col("wall").cast("bigint"), F.lit(NEVER)).alias("wall"), bucket, "id", us("at"), "title", "severity", us("fetched"), "fetched")
    return rows.groupBy("wall", "bucket").transformWithStateInPandas(ForwardItems(), ForwardItems.SCHEMA, "Append", "EventTime")


def forward_wall(log: DataFrame, history: int) -> DataFrame:
    """The ``history`` soonest items of every wall, as the batch upsert gives them."""
    # an item that was forgotten begins again at version 1, later than anything it had
    items = latest(log.withColumn("version", F.struct("fetched_us", "version")), ["wall", "id"])
    kept = keep_last(items, "wall", "at_us", history, newest=False, tie="id")
    return kept.select("wall", "id", F.timestamp_micros("at_us").alias("at"), "title", "severity", F.timestamp_micros("fetched_us").alias("fetched"))


class SilentFeed(StatefulProcessor):
    """One feed's newest reference time; it turns stale by a timer when nothing newer comes in its window."""

    SCHEMA = "id string, ref_us bigint, stale boolean, kept boolean, version bigint"

    def init(self, handle) -> None:
        self.handle = handle
        self.feed = handle.getValueState("feed", "ref_us bigint, window_us bigint, stale boolean, version bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ref, window = max((r.ref_us, r.window_us) for r in rows)
        before = self.feed.get() if self.feed.exists() else None
        if before is not None and before[0] >= ref:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due, version = due_ms(ref + window), (before[3] if before is not None else 0) + 1
        stale = due <= timerValues.getCurrentWatermarkInMs()
        if not stale:
            self.handle.registerTimer(due)
        self.feed.update((ref, window, stale, version))
        yield Row(id=key[0], ref_us=ref, stale=stale, kept=True, version=version)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ref, window, stale, version = self.feed.get()
        if not stale:
            self.feed.update((ref, window, True, version + 1))
            yield Row(id=key[0], ref_us=ref, stale=True, kept=True, version=version + 1)

    def close(self) -> None:
        pass


def staleness_changes(stream: DataFrame, window_ms: Column, lateness: str, time: str = "at") -> DataFrame:
    """Change log of (id, ref, stale) for a stream of (id, ``time``); now is the watermark of that time over all feeds."""
    rows = stream.withWatermark(time, lateness).select("id", epoch_us(time).alias("ref_us"), (window_ms.cast("bigint") * 1000).alias("window_us"), time)
    return rows.groupBy("id").transformWithState(SilentFeed(), SilentFeed.SCHEMA, "Append", "EventTime")

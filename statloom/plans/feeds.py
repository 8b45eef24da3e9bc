"""Feed queries over the events table: event types and users as feeds, event rows as items."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators.ordered import shared, with_one_row
from statloom.plans.registry import query, show
from statloom.plans.tables import table
from statloom.session import scratch_folder
from statloom.sources import feed_registry
from statloom.streaming import keyed, series, walls, windows

# a metric feed per event type; each event is fetched an hour after its time stamp, and some are fetched twice
FEED = """
raw AS (SELECT event_type AS id, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, value, ts AS fetched, event_id FROM events),
merged AS (SELECT id, ts, arg_max(value, epoch_us(fetched) * 1000 + value) AS value, max(fetched) AS fetched FROM raw GROUP BY 1, 2),
kept AS (SELECT id, ts, value, fetched FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS k FROM merged) AS t WHERE k <= 200),
"""


def events(spark, d):
    return table(spark, d, "events")


def timed(spark, d):
    return events(spark, d).withColumn("us", series.epoch_us("ts"))


def feed(spark, d):
    ten = F.window("ts", "10 minutes").getField("start")
    return events(spark, d).select(F.col("event_type").alias("id"), ten.alias("_t"), "value", F.col("ts").alias("fetched")).withColumnRenamed("_t", "ts").withColumn("fetched", F.col("fetched").cast("timestamp"))


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("series_merge", show("SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, value FROM kept", "id, at", "value", FEED))
def _(spark, d):
    return series.merge_series(None, feed(spark, d), 200).select("id", stamp("ts").alias("at"), "value")


def event_stream(spark, d):
    """The events as a stream, and a place for its output and checkpoint."""
    base = scratch_folder(spark, "stream")
    rows = spark.readStream.schema(events(spark, d).schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("at", F.col("ts").cast("timestamp")), f"{base}/log", f"{base}/checkpoint"


@query("series_merge_stream", show("SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, value FROM kept", "id, at", "value", FEED))
def _(spark, d):
    rows, folder, checkpoint = event_stream(spark, d)
    rows = rows.select(F.col("event_type").alias("id"), F.window("ts", "10 minutes").getField("start").cast("timestamp").alias("ts"), "value", F.col("at").alias("fetched"))
    log = keyed.run(keyed.series_changes(rows, 200), folder, checkpoint)
    return keyed.series_points(log).select("id", stamp("ts").alias("at"), "value")


@query(
    "metric_snapshot",
    show(
        "SELECT id, arg_max(value, ts) AS value, arg_max(value - prev, ts) AS delta, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at, min(value) AS min, max(value) AS max, count(*) AS n FROM (SELECT *, lag(value) OVER (PARTITION BY id ORDER BY ts) AS prev FROM kept) AS t GROUP BY 1",
        "id, at, n",
        "value, delta, min, max",
        FEED,
    ),
)
def _(spark, d):
    out = series.snapshot(series.merge_series(None, feed(spark, d), 200))
    return out.select("id", stamp("at").alias("at"), "n", "value", "delta", "min", "max")


WALL = """
items AS (SELECT user_id % 7 AS wall, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'e' || (event_id // 3) END AS id0, ts AS at, event_type || ' ' || props AS title, event_type AS severity, ts AS fetched, (SELECT max(ts) FROM events) AS mx FROM events),
keyed AS (SELECT *, coalesce(id0, substr(strftime(at, '%Y-%m-%d %H:%M:%S.%f') || '|' || title, 1, 200)) AS id FROM items),
lat AS (SELECT wall, id, max(at) AS at, arg_max(title, at) AS title FROM keyed GROUP BY 1, 2),
"""


def wall_items(spark, d):
    return wall_items_of(events(spark, d)).drop("event_id")


def wall_items_of(e):
    return e.select(
        "event_id",
        (F.col("user_id") % 7).alias("wall"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("e"), F.floor(F.col("event_id") / 3).cast("string"))).alias("id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.concat_ws(" ", "event_type", "props").alias("title"),
        F.col("event_type").alias("severity"),
        F.col("ts").cast("timestamp").alias("fetched"),
    )


@query(
    "event_wall_newest",
    show("SELECT wall, strftime(at, '%Y-%m-%d %H:%M:%S') AS at, title FROM (SELECT *, row_number() OVER (PARTITION BY wall ORDER BY at DESC) AS k FROM lat) AS t WHERE k <= 120", "wall, at, title", "", WALL),
)
def _(spark, d):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return walls.upsert_wall(None, wall_items(spark, d), now, 120).select("wall", stamp("at").alias("at"), "title")


@query(
    "event_wall_forward",
    show(
        "SELECT wall, strftime(at, '%Y-%m-%d %H:%M:%S') AS at, title FROM (SELECT *, row_number() OVER (PARTITION BY wall ORDER BY at) AS k FROM lat WHERE at >= TIMESTAMP '2024-01-19 23:00:00') AS t WHERE k <= 80",
        "wall, at, title",
        "",
        WALL,
    ),
)
def _(spark, d):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return walls.upsert_wall(None, wall_items(spark, d), now, 80, forward=True).select("wall", stamp("at").alias("at"), "title")


# items lie up to four days ahead of their fetch; now is a day before the last fetch
AHEAD = WALL.replace("ts AS at,", "ts + to_hours((event_id % 96)::INT) AS at,").replace(
    "arg_max(title, at) AS title", "arg_max(title, (fetched, at, title)) AS title, max(fetched) AS fetched, arg_max(at, (fetched, at, title)) AS newest, any_value(mx) AS mx"
)


@query(
    "event_wall_forward_stream",
    show(
        "SELECT wall, strftime(newest, '%Y-%m-%d %H:%M:%S') AS at, title FROM (SELECT *, row_number() OVER (PARTITION BY wall ORDER BY newest, id) AS k FROM lat WHERE (epoch_us(newest) + 3600000000) // 1000 + 1 > epoch_us(mx) // 1000 - 86400000) AS t WHERE k <= 80",
        "wall, at, title",
        "",
        AHEAD,
    ),
)
def _(spark, d):
    rows, folder, checkpoint = event_stream(spark, d)
    items = wall_items_of(rows).withColumn("at", F.col("at") + F.make_dt_interval(hours=(F.col("event_id") % 96).cast("int"))).drop("event_id")
    log = keyed.run(keyed.forward_wall_changes(items, "1 day"), folder, checkpoint)
    return keyed.forward_wall(log, 80).select("wall", stamp("at").alias("at"), "title")


@query(
    "feed_staleness_stream",
    show(
        """SELECT id, strftime(at, '%Y-%m-%d %H:%M:%S') AS at, (epoch_us(at) + w * 3600000000) // 1000 + 1 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events) AS stale
  FROM (SELECT event_type || '-' || (user_id % 40) AS id, max(ts) AS at, any_value(CASE WHEN event_type = 'error' THEN 48 ELSE 6 END) AS w FROM events GROUP BY 1) AS f""",
        "id, at, stale",
    ),
)
def _(spark, d):
    """A feed for every event type and 40th of the users; it turns stale by a timer, six hours (errors: two days) after its last event."""
    rows, folder, checkpoint = event_stream(spark, d)
    window = F.when(F.col("id").startswith("error-"), 48).otherwise(6) * 3_600_000
    feeds = rows.select(F.concat_ws("-", "event_type", (F.col("user_id") % 40).cast("string")).alias("id"), "at")
    log = keyed.run(keyed.staleness_changes(feeds, window, "1 hour"), folder, checkpoint)
    return keyed.latest(log, ["id"]).select("id", stamp(F.timestamp_micros("ref_us")).alias("at"), "stale")


@query(
    "keep_last_good_stream",
    show(
        """SELECT user_id::VARCHAR AS id, arg_max(value, ts) FILTER (event_type <> 'error') AS value, CASE WHEN any_value(good) IS NULL OR max(ts) > any_value(good) THEN 'fetch failed' END AS last_error,
  count(*) FILTER (good IS NULL OR ts > good) AS error_count FROM events JOIN (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS good FROM events GROUP BY 1) AS g USING (user_id) GROUP BY 1""",
        "id, last_error, error_count",
        "value",
    ),
)
def _(spark, d):
    rows, folder, checkpoint = event_stream(spark, d)
    results = rows.select(F.col("user_id").cast("string").alias("id"), "value", "at", F.when(F.col("event_type") == "error", "fetch failed").alias("error"), F.col("at").alias("fetched"))
    return keyed.latest(keyed.run(keyed.last_good_changes(results), folder, checkpoint), ["id"]).select("id", "value", "last_error", F.col("error_count").cast("bigint").alias("error_count"))


def _reg_sql():
    out = []
    for ident, section, kind, cadence, history, position, _rules in feed_registry.feed_rows():
        unit = {"m": 60000, "h": 3600000, "d": 86400000, "w": 604800000}[cadence[-1]]
        out.append(f"({position}, '{ident}', '{section}', '{kind}', {int(cadence[:-1]) * unit}, {history})")
    return ", ".join(out)


def _ladder_sql():
    parts = []
    for ident, _, _, _, _, position, rules in feed_registry.feed_rows():
        if not rules:
            continue
        for r in rules:
            cond = " AND ".join(f"value {op} {b}" for op, b in zip((">=", ">", "<=", "<", "="), r[1:]) if b is not None)
            parts.append(f"WHEN position = {position} AND {cond} THEN '{r[0]}'")
    none = ", ".join(str(r[5]) for r in feed_registry.feed_rows() if not r[6])
    return f"CASE WHEN value IS NULL OR position IN ({none}) THEN 'unknown' {' '.join(parts)} ELSE 'good' END"


REGISTRY = f"""
reg AS (SELECT * FROM (VALUES {_reg_sql()}) AS r(position, id, section, kind, cadence_ms, history)),
last AS (SELECT user_id % 89 AS position, arg_max(value, ts) AS value, max(ts) AS at, max(ts) + INTERVAL 20 MINUTE AS fetched_at, arg_max(event_type = 'error', ts) AS failed FROM events GROUP BY 1),
snap AS (SELECT reg.*, value, at, fetched_at, coalesce(failed, false) AS failed FROM reg LEFT JOIN last USING (position)),
stat AS (SELECT *, {_ladder_sql()} AS status, coalesce(epoch_ms(TIMESTAMP '2024-01-31 00:00:00') - epoch_ms(CASE WHEN kind = 'events' THEN fetched_at ELSE at END) > greatest(3 * cadence_ms, 7200000), false) AS stale FROM snap),
eff AS (SELECT *, CASE WHEN (stale OR failed) AND status IN ('unknown', 'good') THEN 'warning' ELSE status END AS effective FROM stat),
"""
NOW = "2024-01-31 00:00:00"


def snapshots(spark, d):
    last = events(spark, d).groupBy((F.col("user_id") % 89).cast("int").alias("position")).agg(F.max_by(F.struct("value", "event_type"), "ts").alias("_l"), F.max("ts").cast("timestamp").alias("at"))
    last = last.select("position", F.col("_l.value").alias("value"), "at", (F.col("at") + F.expr("INTERVAL 20 MINUTES")).alias("fetched_at"), (F.col("_l.event_type") == "error").alias("failed"))
    snaps = feed_registry.registry(spark).join(last, "position", "left").withColumn("failed", F.coalesce("failed", F.lit(False))).withColumn("stale_after", F.lit(None).cast("string"))
    now = F.lit(NOW).cast("timestamp")
    rows = snaps.withColumn("status", series.ladder("value", "rules")).withColumn("stale", series.stale_flag(now))
    return rows.withColumn("effective", series.effective_level("status", "stale", "failed"))


@query("feed_status", show("SELECT id, section, kind, history, value, status, stale, failed, effective FROM eff", "id, section, kind, history, status, stale, failed, effective", "value", REGISTRY))
def _(spark, d):
    return feed_registry.public_view(snapshots(spark, d)).select("id", "section", "kind", "history", "value", "status", "stale", "failed", "effective")


@query(
    "feed_status_rollup",
    show(
        """SELECT section, CASE max(CASE effective WHEN 'critical' THEN 5 WHEN 'serious' THEN 4 WHEN 'warning' THEN 3 WHEN 'good' THEN 2 ELSE 1 END) WHEN 5 THEN 'critical' WHEN 4 THEN 'serious' WHEN 3 THEN 'warning' WHEN 2 THEN 'good' ELSE 'unknown' END AS level, count(*) AS n FROM eff GROUP BY ROLLUP (section)""",
        "section, level, n",
        "",
        REGISTRY,
    ),
)
def _(spark, d):
    return series.worst_levels(snapshots(spark, d))


@query(
    "feed_health",
    show("SELECT id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(at)) / 60000000 AS data_age_min, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(fetched_at)) / 60000000 AS fetch_age_min, failed AS has_errors FROM snap", "id, has_errors", "data_age_min, fetch_age_min", REGISTRY),
)
def _(spark, d):
    rows = snapshots(spark, d).withColumn("error_count", F.col("failed").cast("int"))
    return series.health(rows, F.lit(NOW).cast("timestamp")).toDF("id", "data_age_min", "fetch_age_min", "has_errors")


@query(
    "feed_due_gate",
    show(
        "SELECT id, CASE WHEN section = 'net' THEN 'skipped' WHEN fetched_at IS NULL OR kind = 'events' OR epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 1000 - epoch_us(fetched_at) / 1000 >= 0.95 * cadence_ms THEN 'run' ELSE 'fresh' END AS action FROM snap",
        "id, action",
        "",
        REGISTRY,
    ),
)
def _(spark, d):
    runs = snapshots(spark, d).select("id", F.col("fetched_at").alias("last_fetch"))
    out = series.due_feeds(feed_registry.registry(spark), runs, F.lit(NOW).cast("timestamp"), F.col("kind") == "events", F.col("section") != "net")
    return out.select("id", "action")


@query(
    "keep_last_good",
    show(
        """SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL AND NOT n.bad THEN n.value ELSE o.value END AS value, CASE WHEN n.bad THEN 'fetch failed' END AS last_error,
  CASE WHEN n.id IS NOT NULL AND NOT n.bad THEN 0 WHEN n.bad THEN coalesce(o.ec, 0) + 1 ELSE coalesce(o.ec, 0) END AS error_count
  FROM (SELECT user_id AS id, arg_max(value, ts) AS value, (count(*) FILTER (WHERE event_type = 'error') % 3)::INT AS ec FROM events WHERE ts < TIMESTAMP '2024-01-28' GROUP BY 1) AS o
  FULL JOIN (SELECT user_id AS id, arg_max(value, ts) AS value, arg_max(event_type = 'error', ts) AS bad FROM events WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY 1) AS n ON n.id = o.id""",
        "id, last_error, error_count",
        "value",
    ),
)
def _(spark, d):
    e = events(spark, d)
    state = e.filter("ts < TIMESTAMP_NTZ '2024-01-28 00:00:00'").groupBy(F.col("user_id").alias("id")).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("at"), (F.count_if(F.col("event_type") == "error") % 3).cast("int").alias("error_count"))
    new = e.filter("ts >= TIMESTAMP_NTZ '2024-01-30 00:00:00'").groupBy(F.col("user_id").alias("id")).agg(F.max_by(F.struct("value", "event_type"), "ts").alias("_l"), F.max("ts").alias("at"))
    new = new.select("id", F.col("_l.value").alias("value"), "at", F.when(F.col("_l.event_type") == "error", "fetch failed").alias("error"))
    return series.keep_last_good(state, new).select("id", "value", "last_error", "error_count")


@query("run_log", show("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_id AS id FROM events ORDER BY ts DESC, event_id LIMIT 20", "at, id"))
def _(spark, d):
    return walls.run_log(events(spark, d).select(F.col("ts").alias("run_at"), F.col("event_id").alias("id"))).select(stamp("run_at").alias("at"), "id")


@query(
    "bucket_last_five_minutes",
    show("SELECT event_type, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS at, arg_max(value, ts) AS value FROM events GROUP BY 1, 2", "event_type, at", "value"),
)
def _(spark, d):
    return windows.bucket_last(events(spark, d), "event_type", "ts", "value").select("event_type", stamp("bucket").alias("at"), "value")


@query(
    "bucket_extreme_from_centre",
    show(
        "SELECT event_type, at, value FROM (SELECT event_type, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS at, value, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 5 MINUTE, ts) ORDER BY abs(value - 50) DESC, ts DESC) AS k FROM events) AS t WHERE k = 1",
        "event_type, at",
        "value",
    ),
)
def _(spark, d):
    return windows.bucket_extreme(events(spark, d), "event_type", "ts", "value", 50.0).select("event_type", stamp("bucket").alias("at"), "value")


@query(
    "daily_last_mean_extremes",
    show(
        "SELECT event_type, ts::DATE AS day, arg_max(value, ts) AS last, avg(value) AS mean, count(*) FILTER (WHERE value = 0) AS at_zero, count(*) FILTER (WHERE value >= 99) AS at_full, count(*) AS n FROM events GROUP BY 1, 2",
        "event_type, day, at_zero, at_full, n",
        "last, mean",
    ),
)
def _(spark, d):
    return windows.daily_summary(events(spark, d), "event_type", "ts", "value")


@query(
    "sliding_seven_day_total",
    show(
        "SELECT user_id, day, total FROM (SELECT user_id, day, sum(v) OVER w AS total, count(*) OVER w AS k FROM (SELECT user_id, floor(epoch(ts) / 86400)::INT AS day, sum(round(value * 100)::BIGINT)::BIGINT AS v FROM events GROUP BY 1, 2) AS t WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)) AS q WHERE k = 7",
        "user_id, day, total::BIGINT AS total",
    ),
)
def _(spark, d):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("int")
    daily = events(spark, d).groupBy("user_id", day.alias("day")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v"))
    return windows.sliding_total(daily, "user_id", "day", "v").select("user_id", "day", "total")


_LB = ", ".join(f"count(*) FILTER (WHERE h < {h}) AS n_{h}h, min(value) FILTER (WHERE h < {h}) AS min_{h}h, max(value) FILTER (WHERE h < {h}) AS max_{h}h" for h in (3, 6, 12, 24))


@query(
    "lookback_windows",
    show(
        f"SELECT event_type, {_LB} FROM (SELECT *, (epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 3600000000 AS h FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00') AS t GROUP BY 1",
        "event_type, n_3h, n_6h, n_12h, n_24h",
        ", ".join(f"min_{h}h, max_{h}h" for h in (3, 6, 12, 24)),
    ),
)
def _(spark, d):
    return windows.lookback(events(spark, d), "event_type", "ts", "value", F.lit("2024-01-20 00:00:00")).drop("peak_at")


@query(
    "fixed_lag_rate",
    show("SELECT event_type, count(*) FILTER (WHERE h >= 2 AND h < 50) / 48.0 AS rate FROM (SELECT *, (epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 3600000000 AS h FROM events) AS t GROUP BY 1", "event_type", "rate"),
)
def _(spark, d):
    return windows.windowed_rate(events(spark, d), "event_type", "ts", F.lit("2024-01-20 00:00:00"), 2, 48)


@query(
    "sliding_window_counts_stream",
    show(
        "SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 4 HOUR]) AS s FROM events) AS t GROUP BY 1, 2",
        "event_type, start, n",
    ),
)
def _(spark, d):
    base = scratch_folder(spark, "windows")
    src = spark.readStream.schema(events(spark, d).schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windows.sliding_counts(src, "event_type", "ts", "6 hours", "2 hours", "1 hour")

    def land(batch, number):
        # update mode sends every changed window; the newest batch of a window is its state
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = counts.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    landed = spark.read.parquet(f"{base}/out")
    return landed.groupBy("event_type", "start").agg(F.max_by("n", "batch").alias("n")).select("event_type", stamp("start").alias("start"), "n")


@query(
    "incomplete_tail_drop",
    show(
        """SELECT event_type, week, n FROM (SELECT *, max(ok::INT) OVER (PARTITION BY event_type ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS keep FROM (
  SELECT event_type, week, n, coalesce(n >= 0.8 * lag(n) OVER (PARTITION BY event_type ORDER BY week), true) AS ok FROM (SELECT event_type, floor(epoch(ts) / 604800)::INT AS week, count(*) AS n FROM events GROUP BY 1, 2) AS a) AS b) AS c WHERE keep = 1""",
        "event_type, week, n",
    ),
)
def _(spark, d):
    week = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 604_800_000_000).cast("int")
    weekly = events(spark, d).groupBy("event_type", week.alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return windows.drop_incomplete_tail(weekly, "event_type", "week", "n")


@query(
    "guarded_weekly_site_mean",
    show("SELECT event_type, floor(epoch(ts) / 604800)::INT AS week, avg(value) AS mean, count(DISTINCT user_id) AS sites, count(*) AS n FROM events WHERE value <= 100 GROUP BY 1, 2", "event_type, week, sites, n", "mean"),
)
def _(spark, d):
    week = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 604_800_000_000).cast("int")
    return windows.guarded_weekly_mean(events(spark, d).withColumn("week", week), "event_type", "week", "user_id", "value")


@query(
    "category_share",
    show(
        "SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, coalesce(sum(CASE WHEN event_type IN ('view', 'click') AND g > 0 THEN g END), 0) * 100 / sum(CASE WHEN g > 0 THEN g END) AS share, sum(CASE WHEN g > 0 THEN g END) AS total FROM (SELECT *, value - 20 AS g FROM events) AS t GROUP BY 1",
        "day",
        "share, total",
    ),
)
def _(spark, d):
    rows = events(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", (F.col("value") - 20).alias("g"))
    return windows.category_share(rows, ["day"], "event_type", "g", ["view", "click"])


_PIV = ", ".join(f"max(value) FILTER (WHERE event_type = '{t}') AS {t}" for t in ("view", "click", "purchase"))


@query(
    "row_sum_of_present_measures",
    show(f"SELECT user_id, day, CASE WHEN view IS NOT NULL OR click IS NOT NULL OR purchase IS NOT NULL THEN coalesce(view, 0) + coalesce(click, 0) + coalesce(purchase, 0) END AS total FROM (SELECT user_id, floor(epoch(ts) / 86400)::INT AS day, {_PIV} FROM events GROUP BY 1, 2) AS t", "user_id, day", "total"),
)
def _(spark, d):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("int")
    wide = events(spark, d).groupBy("user_id", day.alias("day")).pivot("event_type", ["view", "click", "purchase"]).agg(F.max("value"))
    return wide.select("user_id", "day", windows.row_sum(["view", "click", "purchase"]).alias("total"))


@query(
    "actual_vs_forecast",
    show(
        """SELECT user_id, strftime(max(ts) FILTER (WHERE seen), '%Y-%m-%d %H:%M:%S') AS at, arg_max(value, ts) FILTER (WHERE seen) AS value, arg_max(fc - value, ts) FILTER (WHERE seen) AS headroom, count(*) FILTER (WHERE NOT seen) AS unsettled
  FROM (SELECT user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS value, (event_id % 100)::DOUBLE AS fc, ts <= TIMESTAMP '2024-01-25' AND event_type <> 'error' AS seen FROM events) AS t GROUP BY 1""",
        "user_id, at, unsettled",
        "value, headroom",
    ),
)
def _(spark, d):
    rows = events(spark, d).select("user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("actual"), (F.col("event_id") % 100).cast("double").alias("forecast"))
    out = windows.settled_latest(rows, "user_id", "ts", "actual", "forecast", F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    return out.select("user_id", stamp("at").alias("at"), "value", "headroom", "unsettled")


@query(
    "latest_per_site_then_worst",
    show(
        "SELECT event_type, max(value) AS value, arg_max(user_id, value * 1000 + user_id) AS user_id, count(*) AS sites FROM (SELECT event_type, user_id, arg_max(value, ts) AS value FROM events GROUP BY 1, 2) AS t GROUP BY 1",
        "event_type, user_id, sites",
        "value",
    ),
)
def _(spark, d):
    return windows.latest_then_worst(events(spark, d), "user_id", "event_type", "ts", "value")


@query(
    "calendar_yoy_feed",
    show(
        "SELECT a.id, a.m, a.value, 100 * (a.value / b.value - 1) AS yoy FROM fm a JOIN fm b ON b.id = a.id AND b.m = a.m - 12",
        "id, m",
        "value, yoy",
        "fm AS (SELECT o_orderpriority AS id, year(o_orderdate) * 12 + month(o_orderdate) AS m, sum(round(o_totalprice * 100)::BIGINT) / 100.0 / count(*) AS value FROM orders GROUP BY 1, 2),",
    ),
)
def _(spark, d):
    o = table(spark, d, "orders")
    fm = o.groupBy(F.col("o_orderpriority").alias("id"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int").alias("m")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100.0 / F.count(F.lit(1))).alias("value"))
    return windows.calendar_yoy(fm, "id", "m", "value")


@query(
    "offset_difference",
    show(
        "SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, value - coalesce(lag(value, 52) OVER w, first_value(value) OVER w) AS change FROM kept WINDOW w AS (PARTITION BY id ORDER BY ts)",
        "id, at",
        "change",
        FEED,
    ),
)
def _(spark, d):
    kept = series.merge_series(None, feed(spark, d), 200)
    return windows.offset_difference(kept, "id", "ts", "value", 52).select("id", stamp("ts").alias("at"), "change")


@query(
    "odds_normalise",
    show(
        """SELECT ev, sum(p * mv) / sum(p) AS expected, sum(CASE WHEN mv < 0 THEN p ELSE 0 END) / sum(p) AS cuts, sum(CASE WHEN mv > 0 THEN p ELSE 0 END) / sum(p) AS hikes FROM (
  SELECT user_id AS ev, CASE event_type WHEN 'view' THEN -50 WHEN 'click' THEN -25 WHEN 'signup' THEN 0 WHEN 'purchase' THEN 25 ELSE 50 END AS mv, CASE WHEN max(value) > 60 THEN least(max(value), 100) / 100 WHEN count(*) > 10 THEN 0.2 END AS p FROM events GROUP BY 1, 2) AS t WHERE p IS NOT NULL GROUP BY 1 HAVING sum(p) > 0""",
        "ev",
        "expected, cuts, hikes",
    ),
)
def _(spark, d):
    move = F.when(F.col("event_type") == "view", -50).when(F.col("event_type") == "click", -25).when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 25).otherwise(50)
    p = F.when(F.max("value") > 60, F.least(F.max("value"), F.lit(100.0)) / 100).when(F.count(F.lit(1)) > 10, 0.2)
    rows = events(spark, d).groupBy(F.col("user_id").alias("ev"), move.alias("mv")).agg(p.alias("p"))
    return windows.normalise_odds(rows, "ev", "p", "mv")


@query(
    "nearest_future_event",
    show("SELECT user_id, strftime(coalesce(min(ts) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 12:00:00'), min(ts)), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY 1", "user_id, at"),
)
def _(spark, d):
    return windows.nearest_event(events(spark, d), "user_id", "ts", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("user_id", stamp("at").alias("at"))


@query(
    "best_per_group",
    show("SELECT user_id, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rank FROM events WHERE event_type = 'purchase') AS t WHERE rank <= 10", "user_id, event_id, rank", "value"),
)
def _(spark, d):
    return windows.best_per_group(events(spark, d).filter("event_type = 'purchase'"), "user_id", ["value", "event_id"], 10).select("user_id", "event_id", "rank", "value")


@query(
    "upper_median_of_filtered",
    show("SELECT event_type, count(*) AS n, list_extract(list(value ORDER BY value), count(*) // 2 + 1) AS upper_median FROM events WHERE value > 5 GROUP BY 1", "event_type, n", "upper_median"),
)
def _(spark, d):
    return windows.upper_median(events(spark, d).filter("value > 5"), "event_type", "value")


@query(
    "running_count_over_threshold",
    show("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS running FROM events WHERE value >= 100", "user_id, event_id, running"),
)
def _(spark, d):
    return windows.running_over_threshold(timed(spark, d), "user_id", "us", "event_id", "value", 100.0).select("user_id", "event_id", "running")


@query(
    "running_records",
    show("SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) AS t WHERE b IS NULL OR value > b", "user_id, event_id", "value"),
)
def _(spark, d):
    return windows.running_records(timed(spark, d), "user_id", "us", "value").select("user_id", "event_id", "value")


@query(
    "degraded_sources",
    show(
        "SELECT sum(CASE WHEN n > 0 THEN bad END)::BIGINT AS degraded, count(*) FILTER (WHERE n > 0) AS answered, count(*) AS sources FROM (SELECT user_id, max(CASE WHEN s <> 'operational' THEN 1 WHEN s IS NOT NULL THEN 0 END) AS bad, count(s) AS n FROM (SELECT user_id, CASE WHEN user_id % 11 = 0 THEN NULL WHEN event_type = 'error' AND value > 100 THEN 'down' ELSE 'operational' END AS s FROM events) AS a GROUP BY 1) AS b",
        "degraded, answered, sources",
    ),
)
def _(spark, d):
    s = F.when(F.col("user_id") % 11 == 0, F.lit(None).cast("string")).when((F.col("event_type") == "error") & (F.col("value") > 100), "down").otherwise("operational")
    return windows.degraded_count(events(spark, d).withColumn("s", s), "user_id", "s")


@query(
    "scale_maximum",
    show("SELECT event_id, greatest(r, s, g) AS scale FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE floor(value / 30)::INT END AS r, (user_id % 4)::INT AS s, CASE WHEN event_type = 'view' THEN 5 END AS g FROM events) AS t", "event_id, scale"),
)
def _(spark, d):
    e = events(spark, d)
    r = F.when(F.col("event_type") != "error", F.floor(F.col("value") / 30).cast("int"))
    return e.select("event_id", F.greatest(r, (F.col("user_id") % 4).cast("int"), F.when(F.col("event_type") == "view", 5)).alias("scale"))


@query(
    "dimension_slice_series",
    show("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS at, arg_max(value, ts) AS value FROM events WHERE event_type = 'view' AND value > 0 GROUP BY 1", "at", "value"),
)
def _(spark, d):
    rows = events(spark, d).filter("event_type = 'view' AND value > 0")
    return rows.groupBy(F.window("ts", "1 day").alias("w")).agg(F.max_by("value", "ts").alias("value")).select(stamp("w.start").alias("at"), "value")


@query(
    "event_normalisation",
    show(
        """SELECT 'e' || event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, substr(event_type || ' by user ' || user_id, 1, 18) AS title, CASE WHEN event_type = 'error' THEN 'critical' WHEN event_type IN ('signup', 'purchase') THEN 'warning' ELSE 'info' END AS severity, 'https://example.org/e/' || event_id AS url, props AS meta
  FROM events WHERE epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) <= 240::BIGINT * 3600000000""",
        "id, at, title, severity, url, meta",
    ),
)
def _(spark, d):
    e = events(spark, d)
    number = F.col("event_id").cast("string")
    out = walls.normalise_events(
        e,
        F.concat(F.lit("e"), number),
        F.col("ts"),
        F.concat_ws(" ", "event_type", F.lit("by user"), F.col("user_id").cast("string")),
        walls.severity_by_pattern("event_type", [("error", "critical"), ("signup|purchase", "warning")]),
        F.concat(F.lit("https://example.org/e/"), number),
        F.col("props"),
        F.lit("2024-01-31 00:00:00"),
        240,
        18,
    )
    return out.withColumn("at", stamp("at"))


@query(
    "trailing_maximum",
    show("SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, max(value) OVER (PARTITION BY id ORDER BY ts ROWS BETWEEN 131 PRECEDING AND CURRENT ROW) AS trailing_max FROM kept", "id, at", "trailing_max", FEED),
)
def _(spark, d):
    return windows.trailing_max(series.merge_series(None, feed(spark, d), 200), "id", "ts", "value").select("id", stamp("ts").alias("at"), "trailing_max")


@query(
    "live_bar_replaces_day",
    show(
        "SELECT id, day, CASE WHEN day = (SELECT max(ts)::DATE FROM events) THEN hi ELSE lastv END AS value FROM (SELECT event_type AS id, ts::DATE AS day, arg_max(value, ts) AS lastv, max(value) AS hi FROM events GROUP BY 1, 2) AS t",
        "id, day",
        "value",
    ),
)
def _(spark, d):
    days = shared(events(spark, d).groupBy(F.col("event_type").alias("id"), F.to_date("ts").alias("day")).agg(F.max_by("value", "ts").alias("value"), F.max("value").alias("hi")))
    last = with_one_row(days, days.agg(F.max("day").alias("last"))).filter("day = last").select("id", "day", F.col("hi").alias("value"))
    return series.upsert_on_date(days.select("id", "day", "value"), last)


@query(
    "latest_n_per_source",
    show("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rank FROM documents) AS t WHERE rank <= 5", "source, doc_id, rank"),
)
def _(spark, d):
    return windows.latest_per_source(table(spark, d, "documents").select("source", "doc_id"), "source", [F.desc("doc_id")], 5)


@query(
    "latest_non_null_per_field",
    show(
        "SELECT user_id, arg_max(value, ts) FILTER (WHERE event_type = 'view') AS speed, strftime(max(ts) FILTER (WHERE event_type = 'view'), '%Y-%m-%d %H:%M:%S') AS speed_at, arg_max(value, ts) FILTER (WHERE event_type = 'error') AS bz, strftime(max(ts) FILTER (WHERE event_type = 'error'), '%Y-%m-%d %H:%M:%S') AS bz_at FROM events GROUP BY 1",
        "user_id, speed_at, bz_at",
        "speed, bz",
    ),
)
def _(spark, d):
    rows = events(spark, d).select("user_id", "ts", F.when(F.col("event_type") == "view", F.col("value")).alias("speed"), F.when(F.col("event_type") == "error", F.col("value")).alias("bz"))
    return windows.latest_non_null(rows, "user_id", "ts", ["speed", "bz"]).withColumns({"speed_at": stamp("speed_at"), "bz_at": stamp("bz_at")})


@query(
    "fast_headline_slow_series",
    show(
        "SELECT o.event_type AS id, points, strftime(official_at, '%Y-%m-%d %H:%M:%S') AS official_at, official_value, f.value FROM (SELECT event_type, count(*) AS points, max(b) AS official_at, arg_max(v, b) AS official_value FROM (SELECT event_type, time_bucket(INTERVAL 3 HOUR, ts) AS b, max(value) AS v FROM events GROUP BY 1, 2) AS s GROUP BY 1) AS o JOIN (SELECT event_type, arg_max(value, ts) AS value FROM events GROUP BY 1) AS f USING (event_type)",
        "id, points, official_at",
        "official_value, value",
    ),
)
def _(spark, d):
    e = events(spark, d).withColumnRenamed("event_type", "id")
    slow = e.groupBy("id", F.window("ts", "3 hours").alias("w")).agg(F.max("value").alias("value")).select("id", F.col("w.start").alias("ts"), "value")
    return windows.fast_headline(e.select("id", "ts", "value"), slow, "id").withColumn("official_at", stamp("official_at"))


@query(
    "forecast_for_observed_month",
    show(
        "SELECT o.id, o.m, o.value, coalesce(s.value, f.value) AS forecast FROM ob o LEFT JOIN fc s ON s.id = o.id AND s.m = o.m LEFT JOIN (SELECT id, arg_min(value, m) AS value FROM fc GROUP BY 1) AS f ON f.id = o.id",
        "id, m",
        "value, forecast",
        """ob AS (SELECT o_orderpriority AS id, year(o_orderdate) * 12 + month(o_orderdate) AS m, max(o_totalprice) AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
fc AS (SELECT o_orderpriority AS id, year(o_orderdate) * 12 + month(o_orderdate) AS m, min(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'P' AND o_custkey < 500 GROUP BY 1, 2),""",
    ),
)
def _(spark, d):
    o = table(spark, d, "orders")
    keys = [F.col("o_orderpriority").alias("id"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int").alias("m")]
    ob = o.filter("o_orderstatus <> 'P'").groupBy(*keys).agg(F.max("o_totalprice").alias("value"))
    fc = shared(o.filter("o_orderstatus = 'P' AND o_custkey < 500").groupBy(*keys).agg(F.min("o_totalprice").alias("value")))
    return windows.forecast_for(ob, fc, "id", "m")


@query(
    "top_event_counts_by_period",
    show("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE value >= 100) AS severe FROM events GROUP BY 1", "day, view, error, severe"),
)
def _(spark, d):
    return events(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("view"), F.count_if(F.col("event_type") == "error").alias("error"), F.count_if(F.col("value") >= 100).alias("severe"))

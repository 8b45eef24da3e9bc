"""Ingestion queries: records in the published layouts are written from the tables by Spark, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import cohort, ledger, peers
from statloom.operators.ordered import shared
from statloom.plans.cohort import POP, population
from statloom.plans.compare import _peer_sql
from statloom.plans.ledger import ALLOCATION, COUNTY, CRIME, EMPLOYMENT, FLAGS, ITEMS, NOTE, STAFF, allocation, crime, directory, flags, items, metrics, staff
from statloom.plans.registry import query, show
from statloom.plans.tables import table
from statloom.sources import fixed_width, sinks, tables


def _pad(c, n):
    return F.lpad(F.col(c).cast("string"), n, "0")


def _ledger_lines(spark, d):
    rows = items(spark, d).withColumn("kind", F.when(F.col("unit") % 9 == 0, "1").otherwise("2"))
    legacy_id = F.concat(F.lpad((F.col("unit") % 50).cast("string"), 2, "0"), F.col("kind"), F.lpad((F.col("unit") % 17).cast("string"), 3, "0"), F.lpad(F.col("unit").cast("string"), 8, "0"))
    current_id = F.concat(F.lpad((F.col("unit") % 50).cast("string"), 2, "0"), F.col("kind"), F.lpad((F.col("unit") % 17).cast("string"), 3, "0"), _pad("unit", 6))
    body = F.concat(F.col("code"), F.lpad(F.col("amount").cast("string"), 12, " "), F.lit("2000"), F.col("flag"))
    legacy = rows.filter("year <= 1998").select("year", F.concat(legacy_id, body).alias("line"))
    current = rows.filter("year > 1998").select("year", F.concat(current_id, body).alias("line"))
    crosswalk = rows.filter("unit % 11 <> 0").select(legacy_id.alias("raw_id"), _pad("unit", 6).alias("unit")).distinct()
    return legacy, current, crosswalk


@query(
    "fixed_width_ledger_scan",
    show("SELECT printf('%06d', unit) AS unit, year, code, amount, flag FROM items WHERE unit % 9 <> 0 AND (year > 1998 OR unit % 11 <> 0)", "unit, year, code, amount, flag", "", ITEMS),
)
def _(spark, d):
    legacy, current, crosswalk = _ledger_lines(spark, d)
    a = fixed_width.ledger_items(legacy, fixed_width.LEGACY_ID)
    b = fixed_width.ledger_items(current, fixed_width.CURRENT_ID)
    return fixed_width.bridge_eras(a, b, crosswalk).select("unit", "year", "code", "amount", "flag")


@query(
    "county_ledger_scan",
    show(
        """SELECT printf('%02d', unit % 50) || printf('%03d', unit % 17) AS county, coalesce(sum(amount) FILTER (WHERE substr(code, 2, 2) IN ('04', '05')), 0)::BIGINT * 1000 AS corr, coalesce(sum(amount) FILTER (WHERE substr(code, 2, 2) = '25'), 0)::BIGINT * 1000 AS jud,
  coalesce(sum(amount) FILTER (WHERE substr(code, 2, 2) = '62'), 0)::BIGINT * 1000 AS pol FROM items WHERE unit % 9 = 0 AND year <= 1998 AND substr(code, 1, 1) IN ('E', 'F', 'G') GROUP BY 1""",
        "county, corr, jud, pol",
        "",
        ITEMS,
    ),
)
def _(spark, d):
    return fixed_width.county_spending(_ledger_lines(spark, d)[0], fixed_width.LEGACY_ID)


@query(
    "employment_record_scan",
    show(
        "SELECT CASE WHEN year >= 1999 THEN printf('%06d', unit) ELSE printf('%06d', unit) END AS unit, year, code, ft, ft_flag, ft_pay, year >= 1999 AND unit % 13 = 5 AND unit % 7 <> 0 AS disagrees FROM staff WHERE code <> '999' AND (year >= 1999 OR unit % 7 <> 0) AND NOT (year < 1999 AND unit % 13 = 5)\n  UNION ALL SELECT printf('%06d', unit + 1), year, code, ft, ft_flag, ft_pay, false FROM staff WHERE code <> '999' AND year < 1999 AND unit % 7 <> 0 AND unit % 13 = 5",
        "unit, year, code, ft, ft_flag, ft_pay, disagrees",
        "",
        STAFF,
    ),
)
def _(spark, d):
    rows = staff(spark, d)
    ident = F.concat(F.lit("012"), F.lpad(F.col("unit").cast("string"), 11, "0"))
    line = F.concat(
        ident, F.lit("   "), F.col("code"), F.lpad(F.col("ft").cast("string"), 10, " "), F.lit(" "), F.col("ft_flag"), F.lpad(F.col("ft_pay").cast("string"), 12, " "), F.lit(" "), F.lit("R"), F.lit(" " * 28), _pad("unit", 6)
    )
    # some crosswalk entries point to a neighbour, so the two ids disagree there
    crosswalk = rows.filter("unit % 7 <> 0").select(ident.alias("raw_id"), F.lpad((F.col("unit") + F.when(F.col("unit") % 13 == 5, 1).otherwise(0)).cast("string"), 6, "0").alias("unit")).distinct()
    return fixed_width.employment_items(rows.select("year", line.alias("line")), crosswalk, from_year=1999)


def _wide(spark, d):
    pop = population(spark, d).withColumn("var", F.concat_ws("_", "sex", "age_bin"))
    names = [f"{s}_{b}" for s in ("M", "F") for b in cohort.STANDARD_BINS]
    wide = pop.groupBy("year", "geoid").pivot("var", names).agg(F.sum("count"))
    mapping = spark.createDataFrame([(f"{s}_{b}", s, b) for s in ("M", "F") for b in cohort.STANDARD_BINS if b != "0-4"], "var string, sex string, age_bin string")
    return wide, mapping, names


@query("wide_table_to_tidy", show("SELECT year, geoid, sex, age_bin, sum(count)::BIGINT AS count FROM pop WHERE age_bin <> '0-4' GROUP BY 1, 2, 3, 4", "year, geoid, sex, age_bin, count", "", POP))
def _(spark, d):
    wide, mapping, _ = _wide(spark, d)
    # a cell absent from the wide sheet has no row in the source table either
    return tables.wide_to_tidy(wide, ["year", "geoid"], mapping).filter("count IS NOT NULL")


@query(
    "column_chunk_merge",
    show(
        "SELECT g.year, g.geoid, g.var, coalesce(sum(p.count), 0)::BIGINT::VARCHAR AS cell FROM (SELECT year, geoid, v.s || '_' || b AS var, v.s AS sex, b AS age_bin FROM (SELECT DISTINCT year, geoid FROM pop) CROSS JOIN (VALUES ('M'), ('F')) AS v(s) CROSS JOIN (SELECT DISTINCT age_bin AS b FROM pop)) AS g LEFT JOIN pop p ON p.geoid = g.geoid AND p.sex = g.sex AND p.age_bin = g.age_bin AND p.year = g.year GROUP BY 1, 2, 3",
        "year, geoid, var, cell",
        "",
        POP,
    ),
)
def _(spark, d):
    wide, _, names = _wide(spark, d)
    cells = shared(wide.select("year", "geoid", *[F.col(f"`{n}`").cast("string").alias(n) for n in names]))
    chunks = [cells.select("year", "geoid", *[F.col(f"`{n}`") for n in names[i : i + 12]]) for i in range(0, len(names), 12)]
    # a chunk that reports nothing for a county does not list it
    chunks = [c.filter(F.coalesce(*[F.col(f"`{n}`") for n in c.columns if n not in ("year", "geoid")]).isNotNull()) for c in chunks]
    merged = tables.merge_chunks(chunks, ["year", "geoid"])
    return merged.unpivot(["year", "geoid"], [F.col(f"`{n}`") for n in names], "var", "cell")


SEG = """
seg AS (SELECT printf('%03d', c_nationkey) AS geo, CASE WHEN c_nationkey < 20 THEN '050' ELSE '040' END AS level, o_orderpriority AS race, CASE WHEN c_mktsegment < 'H' THEN 'F' ELSE 'M' END AS sex, 'a' || (o_orderkey % 31) AS age, count(*) AS count FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
"""


@query(
    "segment_merge_race_collapse",
    show("SELECT geo, sex, age, sum(count)::BIGINT AS count, any_value(complete) AS complete FROM seg JOIN (SELECT geo, count(DISTINCT race || sex || age) = 310 AS complete FROM seg WHERE level = '050' GROUP BY 1) AS c USING (geo) WHERE level = '050' GROUP BY 1, 2, 3", "geo, sex, age, count, complete", "", SEG),
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.format_string("%03d", "c_nationkey").alias("geo"),
        F.when(F.col("c_nationkey") < 20, "050").otherwise("040").alias("level"),
        F.col("o_orderpriority").alias("race"),
        F.when(F.col("c_mktsegment") < "H", "F").otherwise("M").alias("sex"),
        F.concat(F.lit("a"), (F.col("o_orderkey") % 31).cast("string")).alias("age"),
    ).agg(F.count(F.lit(1)).alias("count"))
    rows = shared(rows)
    parts = [rows.filter(F.col("age").rlike(p)) for p in ("^a[0-7]$", "^a[89]$", "^a1.", "^a[23].")]
    return tables.merge_segments(parts)


RAW = """
rawc AS (SELECT lpad((c_nationkey % 7)::VARCHAR, 2, '0') || CASE WHEN c_custkey % 3 = 0 THEN '5' ELSE '' END AS state, lpad(c_nationkey::VARCHAR, 3, '0') || CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE '' END AS county, count(*) AS count FROM customer WHERE c_nationkey <> 24 GROUP BY 1, 2),
geos AS (SELECT CASE substr(state, 1, 2) || substr(county, 1, 3) WHEN '00007' THEN '00014' WHEN '03003' THEN NULL ELSE substr(state, 1, 2) || substr(county, 1, 3) END AS geo, state || '/' || county AS raw, count FROM rawc),
"""


@query(
    "county_table_cleaning",
    show("SELECT geo, sum(count)::BIGINT AS count, count(DISTINCT raw) > 1 AS collision FROM geos WHERE geo IS NOT NULL GROUP BY 1", "geo, count, collision", "", RAW),
)
def _(spark, d):
    c = table(spark, d, "customer")
    state = F.concat(F.lpad((F.col("c_nationkey") % 7).cast("string"), 2, "0"), F.when(F.col("c_custkey") % 3 == 0, "5").otherwise(""))
    county = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.when(F.col("c_custkey") % 2 == 0, "0").otherwise(""))
    # the second header row of the published file comes along as a non-numeric state
    state = F.when(F.col("c_nationkey") == 24, "State Code").otherwise(state)
    raw = c.groupBy(state.alias("state"), county.alias("county")).agg(F.count(F.lit(1)).alias("count"))
    over = spark.createDataFrame([("00007", "00014"), ("03003", "")], "geo string, new_geo string")
    return tables.clean_county_rows(raw, over).groupBy("geo").agg(F.sum("count").alias("count"), F.max("collision").alias("collision"))


@query(
    "state_level_fallback",
    show("SELECT n_name AS geo, count(c_custkey) AS count FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 UNION ALL SELECT n_name, -1 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 7) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')", "geo, count"),
)
def _(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("geo"))
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    main = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("geo").agg(F.count(F.lit(1)).alias("count"))
    return tables.with_fallback_rows(main, n.select("geo", F.lit(-1).cast("bigint").alias("count")), "geo")


@query(
    "percent_distribution_sheet",
    show(
        """SELECT month, source, pct, sum(pct) OVER (PARTITION BY month) BETWEEN 98 AND 102 AS adds_up FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS source, 100.0 * count(*) / any_value(t.n) AS pct FROM orders JOIN (SELECT strftime(o_orderdate, '%Y-%m') AS mm, count(*) AS n FROM orders GROUP BY 1) AS t ON t.mm = strftime(o_orderdate, '%Y-%m') GROUP BY 1, 2) AS q WHERE NOT (source = '5-LOW' AND month LIKE '%-03')""",
        "month, source, adds_up",
        "pct",
    ),
)
def _(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority")
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    total = o.groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    wide = o.groupBy("month").pivot("o_orderpriority", kinds).count().join(total, "month")
    text = [F.when((F.lit(k) == "5-LOW") & F.col("month").endswith("-03"), "(x)").otherwise((F.col(f"`{k}`") * 100.0 / F.col("n")).cast("string")).alias(k.replace(" ", "_")) for k in kinds]
    out = tables.percent_sheet(wide.select("month", *text), "month", [k.replace(" ", "_") for k in kinds])
    return out.withColumn("source", F.replace("source", F.lit("_"), F.lit(" ")))


@query(
    "response_rate_load",
    show("SELECT month, metric, 'percent' AS unit, 100 * rate AS value FROM (SELECT strftime(l_shipdate, '%Y-%m') AS month, unnest(['returned', 'open']) AS metric, unnest([avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END), avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0 END)]) AS rate FROM lineitem GROUP BY 1) AS t", "month, metric, unit", "value"),
)
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag", "l_linestatus")
    wide = li.groupBy("month").agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("col_a"), F.avg((F.col("l_linestatus") == "O").cast("double")).alias("col_b"))
    mapping = spark.createDataFrame([("col_a", "returned", "percent", 100.0), ("col_b", "open", "percent", 100.0)], "column string, metric string, unit string, scale double")
    return tables.response_long(wide, "month", mapping)


@query(
    "collection_mode_load",
    show("SELECT strftime(ts, '%Y-%m-%d') AS month, replace(event_type || ' mode', ' ', '_') AS mode, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2", "month, mode", "value"),
)
def _(spark, d):
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("month"), "event_type")
    kinds = ["view", "signup", "click", "error", "purchase"]
    wide = e.groupBy("month").pivot("event_type", kinds).count()
    return tables.mode_long(wide.select("month", *[F.col(k).alias(f"{k.title()} Mode") for k in kinds]), "month")


@query(
    "wide_monthly_melt",
    show("SELECT r_name AS region, strftime(o_orderdate, '%Y-%m') AS ym, count(*)::BIGINT AS value FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA' GROUP BY 1, 2", "region, ym, value"),
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    # the stored table has one column a month, from the first to the last there is
    lo, hi = o.agg(F.min("ym"), F.max("ym")).first()
    months = [f"{y}-{m:02d}" for y in range(int(lo[:4]), int(hi[:4]) + 1) for m in range(1, 13) if lo <= f"{y}-{m:02d}" <= hi]
    wide = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("region").pivot("ym", months).count()
    return tables.melt_months(wide, "region", F.col("region") != "ASIA")


@query(
    "filtered_columnar_read",
    show("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_suppkey IN (3, 7, 11, 19)", "l_orderkey, l_partkey, l_suppkey, l_linenumber"),
)
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").filter(F.col("l_suppkey").isin(3, 7, 11, 19))


@query(
    "multi_file_latest_wins",
    show("SELECT area, item, m, arg_max(v, f * 1000000000 + k) AS v FROM (SELECT l_suppkey AS area, l_linenumber AS item, year(l_shipdate) * 12 + month(l_shipdate) AS m, l_extendedprice AS v, l_orderkey * 10000 + l_partkey AS k, CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END::BIGINT AS f FROM lineitem) AS t GROUP BY 1, 2, 3", "area, item, m", "v"),
)
def _(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("area"), F.col("l_linenumber").alias("item"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("m"), F.col("l_extendedprice").alias("v"), "l_linestatus", (F.col("l_orderkey") * 10000 + F.col("l_partkey")).alias("k")
    )
    parts = [li.filter(F.col("l_linestatus") == s).drop("l_linestatus").withColumn("file", F.struct(F.lit(i).alias("f"), F.col("k"))).drop("k") for i, s in enumerate(("F", "O"))]
    return tables.latest_wins(parts, ["area", "item", "m"], "file").drop("file")


@query(
    "suppression_aware_wages",
    show("SELECT event_id, CASE WHEN event_type = 'error' OR value < 10 THEN NULL ELSE round(value, 1) * 1000 END AS wage, NOT (event_type = 'error' OR value < 10) AS disclosed FROM events", "event_id, disclosed", "wage"),
)
def _(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_type") == "error", "-").when(F.col("value") < 10, "0").otherwise(F.format_number(F.round("value", 1) * 1000, 0))
    return tables.suppressed_wages(e.select("event_id", text.alias("wage")), "wage")


@query(
    "nested_map_json",
    show("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S.%f') AS stamp, event_type AS fuel, value - 20 AS gen FROM events", "user_id, day, stamp, fuel", "gen"),
)
def _(spark, d):
    e = table(spark, d, "events")
    stamp = F.date_format("ts", "HH:mm:ss.SSSSSS")
    fuels = F.create_map("event_type", F.struct((F.col("value") - 20).alias("gen")))
    docs = e.select("user_id", F.to_json(F.struct(F.create_map(F.date_format("ts", "yyyy-MM-dd"), F.create_map(stamp, fuels)).alias("data"))).alias("body"))
    return tables.nested_mix(docs, "body")


@query("column_array_json", show("SELECT event_id, user_id::VARCHAR AS des, value::VARCHAR AS dist FROM events", "event_id::VARCHAR AS event_id, des, dist"))
def _(spark, d):
    e = table(spark, d, "events")
    row = F.array(F.col("value").cast("string"), F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    docs = e.select(F.to_json(F.struct(F.array(F.lit("dist"), F.lit("event_id"), F.lit("des")).alias("fields"), F.array(row).alias("data"))).alias("body"))
    return tables.column_arrays(docs, "body", ["event_id", "des", "dist"])


@query("parallel_array_json", show("SELECT o_orderkey AS doc, unnest([l_linenumber, l_linenumber + 0.5])::DOUBLE AS timestamp, unnest([l_extendedprice, l_quantity]) AS close FROM lineitem JOIN orders ON o_orderkey = l_orderkey", "doc", "timestamp, close"))
def _(spark, d):
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber").cast("double")
    docs = li.select(F.col("l_orderkey").alias("doc"), F.to_json(F.struct(F.array(n, n + 0.5).alias("timestamp"), F.array("l_extendedprice", "l_quantity").alias("close"))).alias("body"))
    return tables.parallel_arrays(docs, "body", ["timestamp", "close"])


@query("pipe_delimited_feed", show("SELECT event_id::BIGINT AS id, event_type AS kind, value FROM events WHERE user_id % 10 <> 3", "id, kind", "value"))
def _(spark, d):
    e = table(spark, d, "events")
    line = F.when(F.col("user_id") % 10 == 3, F.concat(F.lit("# "), "props")).otherwise(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("value").cast("string")))
    return tables.delimited(e.select(line.alias("line")), "id bigint, kind string, value double")


@query("whitespace_delimited_feed", show("SELECT event_id::BIGINT AS id, user_id::BIGINT AS who, value FROM events", "id, who", "value"))
def _(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit("  "), F.col("event_id").cast("string"), F.lit("   "), F.col("user_id").cast("string"), F.lit(" "), F.col("value").cast("string"))
    return tables.delimited(e.select(line.alias("line")), "id bigint, who bigint, value double", sep=" ")


@query(
    "rss_feed_items",
    show(
        """SELECT user_id, event_type || ' & <' || event_id || '>' AS title, 'https://example.org/' || event_id AS link, strftime(ts, '%Y-%m-%d') AS published, CASE WHEN event_id % 3 = 0 THEN props END AS summary, 'e' || event_id AS item_id FROM events""",
        "user_id, title, link, published, summary, item_id",
    ),
)
def _(spark, d):
    """A document of all items of a user's day, RSS for even users and Atom for odd ones."""
    e = table(spark, d, "events")
    number, at = F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")
    name = F.concat(F.col("event_type"), F.lit(" &amp; &lt;"), number, F.lit("&gt;"))
    link, more = F.concat(F.lit("https://example.org/"), number), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<description><![CDATA["), "props", F.lit("]]></description>"))).otherwise("")
    rss = F.concat(F.lit("<item><title>"), name, F.lit("</title><link>"), link, F.lit("</link>"), more, F.lit("<pubDate>"), at, F.lit("</pubDate><guid>e"), number, F.lit("</guid></item>"))
    atom_more = F.regexp_replace(more, "description", "summary")
    atom = F.concat(F.lit("<entry><title type='text'>"), name, F.lit('</title><link rel="x" href="'), link, F.lit('"/>'), atom_more, F.lit("<updated>"), at, F.lit("</updated><id>e"), number, F.lit("</id></entry>"))
    item = F.when(F.col("user_id") % 2 == 0, rss).otherwise(atom)
    docs = e.groupBy("user_id", at.alias("day")).agg(F.concat_ws("\n", F.sort_array(F.collect_list(item))).alias("body"))
    return tables.feed_items(docs, "body").drop("day")


@query(
    "html_weight_table",
    show("SELECT l_orderkey AS page, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS name, l_quantity AS w1, round(l_extendedprice, 2) AS w2, CASE WHEN l_linenumber >= 5 THEN 'special' ELSE 'main' END AS section FROM lineitem", "page, name, section", "w1, w2"),
)
def _(spark, d):
    """A page per order with its lines in order; the marker stands before those from number five on."""
    li = table(spark, d, "lineitem")
    row = F.concat(F.lit("<tr class='r'><th scope='row'><p>"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")), F.lit("</p></th><td>"), F.col("l_quantity").cast("string"), F.lit("</td><td> "), F.col("l_extendedprice").cast("string"), F.lit("</td></tr>"))
    pages = li.groupBy(F.col("l_orderkey").alias("page")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("r")))).alias("rows"))
    part = lambda cond: F.transform(F.filter("rows", cond), lambda x: x["r"])
    marker = F.array(F.lit("<tr><td colspan=3>Special aggregate indexes</td></tr>"))
    body = F.array_join(F.concat(part(lambda x: x["l_linenumber"] < 5), marker, part(lambda x: x["l_linenumber"] >= 5)), "\n")
    pages = pages.select("page", F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))
    return tables.weight_rows(pages, "html").drop("position")


# patterns of invented titles and their categories, the first one counts
_NOTICES = [(r"^(the|le|die|el) ", "shutdown"), (r"tion", "revision"), (r"er( |$)", "method"), (r"^[a-f]", "release")]
_NOTICE_SQL = " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{c}'" for p, c in _NOTICES)


@query(
    "dated_notice_list",
    show(
        rf"""SELECT url, title, strftime(day, '%Y-%m-%d') AS day, category, category IN ('shutdown', 'revision') AS high_impact FROM (SELECT *, CASE {_NOTICE_SQL} ELSE 'other' END AS category FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, title, day NULLS FIRST) AS k FROM (
  SELECT page_id, url, trim(regexp_replace(body, '\(\d{{2}}/\d{{2}}/\d{{4}}\)\s*$', '')) AS title, try_strptime(nullif(regexp_extract(body, '\((\d{{2}}/\d{{2}}/\d{{4}})\)\s*$', 1), ''), '%m/%d/%Y') AS day FROM (
   SELECT page_id, regexp_extract(li, 'href="([^"]*)"', 1) AS url, trim(regexp_replace(li, '<[^>]+>', '', 'g')) AS body FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS li FROM pages) AS a) AS b) AS c WHERE url <> '') AS q WHERE k = 1) AS r""",
        "url, title, day, category, high_impact",
    ),
)
def _(spark, d):
    notices = tables.dated_notices(table(spark, d, "pages").select("page_id", "html"), "html", "page_id", _NOTICES, ["shutdown", "revision"])
    return notices.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "baseline_row_filter",
    show("SELECT county, sex, agegrp, count, count(*) OVER (PARTITION BY county) = 36 AS complete FROM (SELECT printf('%03d', l_suppkey) AS county, (l_linenumber % 3)::INT AS sex, (l_partkey % 19)::INT AS agegrp, count(*) AS count FROM lineitem WHERE l_suppkey IN (1, 2, 3, 4, 5) GROUP BY 1, 2, 3) AS t WHERE sex <> 0 AND agegrp <> 0", "county, sex, agegrp, count, complete"),
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.groupBy(F.format_string("%03d", "l_suppkey").alias("county"), (F.col("l_linenumber") % 3).cast("int").alias("sex"), (F.col("l_partkey") % 19).cast("int").alias("agegrp")).agg(F.count(F.lit(1)).alias("count")).withColumn("state", F.lit("08"))
    return tables.baseline_rows(rows, "08", ["001", "002", "003", "004", "005"]).drop("state")


@query("county_to_metro", show("SELECT lpad(c_nationkey::VARCHAR, 2, '0') || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS fips, c_name AS metro FROM customer WHERE c_mktsegment = 'BUILDING'", "fips, metro"))
def _(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_nationkey").alias("state"), (F.col("c_custkey") % 1000).alias("county"), F.col("c_name").alias("metro"), F.when(F.col("c_mktsegment") == "BUILDING", "Metropolitan").otherwise("Micropolitan").alias("kind"))
    return tables.county_to_metro(rows)


@query("concordance_cleaning", show("SELECT lpad(p_partkey::VARCHAR, 6, '0') AS code, upper(p_type || p_size) AS target FROM part WHERE p_size % 5 <> 0", "code, target"))
def _(spark, d):
    p = table(spark, d, "part")
    code = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(" "))).otherwise("UCC")
    return tables.concordance_rows(p.select(code.alias("code"), F.concat(F.lit(" "), F.lower("p_type"), F.col("p_size").cast("string")).alias("target")))


@query("weight_back_fill", show("SELECT year(l_shipdate) AS weight_year, CASE p_brand WHEN 'Brand#1' THEN 'Brand#01' ELSE p_brand END AS name, count(*) AS w FROM lineitem JOIN part ON p_partkey = l_partkey WHERE year(l_shipdate) NOT IN (1996, 1998) GROUP BY 1, 2", "weight_year, name, w"))
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("weight_year"))
    rows = li.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name")), F.col("l_partkey") == F.col("p_partkey")).groupBy("weight_year", "name").agg(F.count(F.lit(1)).alias("w"))
    renames = spark.createDataFrame([("Brand#1", "Brand#01")], "old string, new string")
    stored = li.filter(F.col("weight_year").isin(1996, 1998)).select("weight_year")
    return tables.new_weight_years(rows, stored, renames)


@query("series_family_slice", show("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size > 40)", "l_orderkey, l_linenumber, l_partkey, l_suppkey", "l_quantity"))
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("series"), "l_suppkey", "l_quantity")
    wanted = table(spark, d, "part").filter("p_type = 'PROMO' AND p_size > 40").select(F.col("p_partkey").alias("series"))
    return tables.series_slice(li, wanted, "series").withColumnRenamed("series", "l_partkey")


@query("survey_expectation_series", show("SELECT strftime(o_orderdate, '%Y-%m') AS ym, max(o_totalprice) AS value FROM orders GROUP BY 1", "ym", "value"))
def _(spark, d):
    o = table(spark, d, "orders")
    rows = o.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("period")).agg(F.max("o_totalprice").cast("string").alias("Median one-year ahead"), F.min("o_totalprice").cast("string").alias("other"))
    preamble = rows.limit(0).unionByName(o.groupBy(F.col("o_orderpriority").alias("period")).agg(F.lit("notes").alias("Median one-year ahead"), F.lit("notes").alias("other")))
    return tables.survey_expectations(rows.unionByName(preamble), "period", "median one")


@query("exact_description_lookup", show("SELECT first(name ORDER BY length(name), name) AS name, count(*) AS candidates FROM (SELECT c_name AS name, c_mktsegment AS description FROM customer) AS t WHERE upper(description) = 'BUILDING'", "name, candidates"))
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" [3] ")).alias("description"))
    return tables.exact_table(c, "Building")


@query("padded_cells_trimmed", show("SELECT doc_id::VARCHAR AS doc_id, lang, source FROM documents", "doc_id, lang, source"))
def _(spark, d):
    docs = table(spark, d, "documents")
    pad = lambda c: F.concat(F.lit("  "), F.col(c).cast("string"), F.lit("   "))
    return tables.trim_all(docs.select(pad("doc_id").alias(" doc_id "), pad("lang").alias("lang  "), pad("source").alias(" source")))


@query(
    "columnar_json_documents",
    show("SELECT item, '{\"m\":' || to_json(list(m ORDER BY m)) || ',\"n\":' || to_json(list(n ORDER BY m)) || '}' AS document FROM (SELECT p_brand AS item, year(l_shipdate) * 12 + month(l_shipdate) AS m, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) AS t GROUP BY 1", "item, document"),
)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("m"))
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("item"))
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("item", "m").agg(F.count(F.lit(1)).alias("n"))
    return sinks.columnar_documents(rows, "item", "m", ["n"])


# peers of a unit by its last year's people, its state's number as price level, and its flags
CITY_PEERS = """
u AS (SELECT * FROM (SELECT unit AS pid, pop, 90.0 + s_nationkey AS rpp, consolidated AS consolidated_or_independent, runs_schools, fire_external, police_contracted, county_like AS county_like_functions, record_complete AS complete
  FROM fl JOIN directory USING (unit, year) JOIN supplier ON s_suppkey = unit QUALIFY row_number() OVER (PARTITION BY unit ORDER BY year DESC) = 1) WHERE pop > 0),
"""
CITY = FLAGS + CRIME.replace(ITEMS, "") + EMPLOYMENT.replace(ITEMS, "") + COUNTY + CITY_PEERS + f"""
peer AS ({_peer_sql()}),
alloc AS ({ALLOCATION}),
parity AS (SELECT state, year, 1000 * sum(pop) // count(*) AS level FROM directory GROUP BY 1, 2),
"""


def _city_json(cte, unit, order, fields, how="list"):
    """A part of the bundle as DuckDB builds it: an ordered list of structs, or the last one."""
    struct = "{" + ", ".join(f"'{f}': {f}" for f in fields) + "}"
    inner = f"list({struct} ORDER BY {order})" if how == "list" else f"arg_max({struct}, {order})"
    return f"(SELECT to_json({inner}) FROM ({cte}) AS t WHERE t.{unit} = d.unit)"


def city_parts(spark, d):
    """Nine tables of a city: (table, order, columns, how)."""
    places = directory(spark, d).select("unit", "year", "name", "state", F.col("pop").cast("bigint").alias("pop"))
    rows = metrics(spark, d)
    noted = flags(spark, d)
    units = flags(spark, d, listed=False).drop("note").join(places, ["unit", "year"]).join(rows.select("unit", "year", "record_complete"), ["unit", "year"])
    newest = units.groupBy("unit").agg(F.max_by(F.struct(*[c for c in units.columns if c != "unit"]), "year").alias("_l")).select("unit", "_l.*")
    level = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), (F.lit(90.0) + F.col("s_nationkey")).alias("rpp"))
    alike = newest.join(level, "unit").filter("pop > 0").select(
        F.col("unit").alias("pid"), F.col("pop").cast("double").alias("pop"), "rpp", F.col("consolidated").alias("consolidated_or_independent"), "runs_schools",
        "fire_external", "police_contracted", F.col("county_like").alias("county_like_functions"), F.col("record_complete").alias("complete"),
    )
    ranked = peers.nearest_peers(alike).select(F.col("pid").alias("unit"), "rank", F.col("peer_pid").alias("peer"))
    crew = ledger.employment_metrics(staff(spark, d), places.select("unit", "year", "pop"))
    heads = [F.col(c).cast("bigint").alias(c) for c in ("police_sworn_ft", "police_other_ft", "fire_firefighters_ft")]
    justice = allocation(spark, d).select(F.col("place").alias("unit"), F.col("n_counties").cast("bigint").alias("n_counties"), "has_county_government")
    parity = places.groupBy("state", "year").agg(F.floor(F.sum("pop") * 1000 / F.count(F.lit(1))).alias("level"))
    money = ["police_usd", "fire_usd", "general_expenditure_usd", "total_expenditure_usd"]
    return {
        "people": (places, "year", ["pop"], "series"),
        "headline": (rows.select("unit", "year", *money, "police_flags", "fire_flags", "record_complete"), "year", [*money, "police_flags", "fire_flags", "record_complete"], "last"),
        "flags": (noted, "year", ["consolidated", "runs_schools", "county_like", "fire_external", "police_contracted", "note"], "last"),
        "spending": (rows, "year", ["police_usd", "fire_usd"], "series"),
        "crime": (crime(spark, d), "year", ["violent", "property", "coverage"], "series"),
        "staffing": (crew.select("unit", "year", *heads, "police_flag_class", "fire_flag_class"), "year", ["police_sworn_ft", "police_other_ft", "fire_firefighters_ft", "police_flag_class", "fire_flag_class"], "series"),
        "peers": (ranked, "rank", ["peer"], "series"),
        "justice": (justice, "n_counties", ["has_county_government"], "last"),
        "prices": (places.join(parity, ["state", "year"]), "year", ["level"], "last"),
    }


_CITY_SQL = {
    "people": ("SELECT unit, year, pop::BIGINT AS pop FROM directory", "year", ["year", "pop"], "list"),
    "headline": ("SELECT * FROM metrics", "year", ["year", "police_usd", "fire_usd", "general_expenditure_usd", "total_expenditure_usd", "police_flags", "fire_flags", "record_complete"], "last"),
    "flags": (f"SELECT *, {NOTE} AS note FROM fl", "year", ["year", "consolidated", "runs_schools", "county_like", "fire_external", "police_contracted", "note"], "last"),
    "spending": ("SELECT * FROM metrics", "year", ["year", "police_usd", "fire_usd"], "list"),
    "crime": ("SELECT * FROM cov", "year", ["year", "violent", "property", "coverage"], "list"),
    "staffing": ("SELECT unit, year, police_sworn_ft::BIGINT AS police_sworn_ft, police_other_ft::BIGINT AS police_other_ft, fire_firefighters_ft::BIGINT AS fire_firefighters_ft, police_flag_class, fire_flag_class FROM emp", "year", ["year", "police_sworn_ft", "police_other_ft", "fire_firefighters_ft", "police_flag_class", "fire_flag_class"], "list"),
    "peers": ("SELECT pid AS unit, rank, peer_pid AS peer FROM peer", "rank", ["rank", "peer"], "list"),
    "justice": ("SELECT place AS unit, n_counties, has_county_government FROM alloc", "n_counties", ["n_counties", "has_county_government"], "last"),
    "prices": ("SELECT unit, year, level FROM directory JOIN parity USING (state, year)", "year", ["year", "level"], "last"),
}


@query(
    "city_bundle_export",
    show(
        "SELECT d.unit, " + ", ".join(f"{_city_json(cte, 'unit', order, fields, how)} AS {name}" for name, (cte, order, fields, how) in _CITY_SQL.items()) + " FROM (SELECT DISTINCT unit FROM directory) AS d",
        "unit, " + ", ".join(_CITY_SQL),
        "",
        CITY,
    ),
)
def _(spark, d):
    parts = city_parts(spark, d)
    out = sinks.assembled("unit", parts)
    return out.withColumns({name: F.when(F.size(name) > 0, F.to_json(name, {"ignoreNullFields": "false"})) if how == "series" else F.to_json(name, {"ignoreNullFields": "false"}) for name, (_, _, _, how) in parts.items()})


_SHEET = ["headline", "flags", "spending", "crime", "staffing", "peers", "prices"]


@query(
    "city_fact_sheet",
    show(
        "SELECT d.unit, name, state, pop, " + ", ".join(f"{_city_json(cte, 'unit', order, fields, how)} AS {name}" for name, (cte, order, fields, how) in ((n, _CITY_SQL[n]) for n in _SHEET))
        + " FROM (SELECT unit, arg_max(name, year) AS name, arg_max(state, year) AS state, arg_max(pop, year)::BIGINT AS pop FROM directory GROUP BY 1) AS d",
        "unit, name, state, pop, " + ", ".join(_SHEET),
        "",
        CITY,
    ),
)
def _(spark, d):
    """Name, latest figures and flags, histories, staffing, crime and peers of every unit, one row each."""
    parts = city_parts(spark, d)
    parts = {"who": (parts["people"][0], "year", ["name", "state", "pop"], "last"), **{n: parts[n] for n in _SHEET}}
    out = sinks.assembled("unit", parts).select("unit", "who.name", "who.state", "who.pop", *_SHEET)
    return out.withColumns({n: F.when(F.size(n) > 0, F.to_json(n, {"ignoreNullFields": "false"})) if parts[n][3] == "series" else F.to_json(n, {"ignoreNullFields": "false"}) for n in _SHEET})


@query("data_vintage", show("SELECT 'orders' AS source, max(year(o_orderdate)) AS last_year FROM orders UNION ALL SELECT 'lines', max(year(l_shipdate)) FROM lineitem UNION ALL SELECT 'events', max(year(ts)) FROM events", "source, last_year"))
def _(spark, d):
    return sinks.data_vintage(
        {
            "orders": (table(spark, d, "orders").select(F.year("o_orderdate").alias("y")), "y"),
            "lines": (table(spark, d, "lineitem").select(F.year("l_shipdate").alias("y")), "y"),
            "events": (table(spark, d, "events").select(F.year("ts").alias("y")), "y"),
        }
    )


"""Scalar-function queries over documents, conversations, pages and key columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import calendar, stats, text
from statloom.operators.cohort import FINE_BANDS, STANDARD_BINS, recode
from statloom.plans.registry import query, show
from statloom.plans.tables import table
from statloom.streaming import walls


@query(
    "lenient_numbers",
    show(
        "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS number FROM events",
        "event_id",
        "number",
    ),
)
def _(spark, d):
    e = table(spark, d, "events")
    missing = F.element_at(F.array(*[F.lit(t) for t in ("", " . ", "N/A", "-", "M", "-999.9", "null")]), (F.col("user_id") % 7 + 1).cast("int"))
    shown = F.concat(F.lit(" $"), F.format_number("value", 2), F.lit("%"))
    return e.select("event_id", text.lenient_number(F.when(F.col("event_id") % 6 == 0, missing).otherwise(shown)).alias("number"))


@query(
    "text_keys",
    show(
        r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '&[a-z]+;|&#\d+;', ' ', 'g'), '\(\d+\)|\[\d+\]', '', 'g'), '[^a-z0-9]', '', 'g')) AS alnum, md5(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
  upper(source) AS description FROM documents""",
        "doc_id, alnum, slug, description",
    ),
)
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.alnum_key("text")).alias("alnum"), F.md5(text.slug("text")).alias("slug"), text.description_key(F.concat("source", F.lit(" [12] "))).alias("description"))


_RULES = [("shutdown", r"shutdown|lapse"), ("ration", r"ration|nation"), ("hand", r"\bhand|\band"), ("lich", r"lich|keit"), ("tion", r"tion")]
_RULE_SQL = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in _RULES)


@query(
    "first_match_categories",
    show(f"SELECT doc_id, category, category IN ('shutdown', 'hand') AS high_impact FROM (SELECT doc_id, CASE {_RULE_SQL} ELSE 'other' END AS category FROM documents) AS t", "doc_id, category, high_impact"),
)
def _(spark, d):
    category = text.first_match("text", [(p, n) for n, p in _RULES], "other")
    return table(spark, d, "documents").select("doc_id", category.alias("category")).withColumn("high_impact", F.col("category").isin("shutdown", "hand"))


@query(
    "message_headlines",
    show(
        """SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^[A-Z][a-z]+ [a-z]+.*,'))[1] AS headline, CASE WHEN role = 'user' THEN conv_id::VARCHAR END AS serial FROM conversations
  WHERE len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^[A-Z][a-z]+ [a-z]+.*,'))) > 0""",
        "conv_id, turn, headline, serial",
    ),
)
def _(spark, d):
    c = table(spark, d, "conversations")
    body = F.concat("text", F.when(F.col("role") == "user", F.concat(F.lit("\nSerial Number: "), F.col("conv_id").cast("string"))).otherwise(""))
    rows = c.select("conv_id", "turn", text.first_line(body, r"^[A-Z][a-z]+ [a-z]+.*,").alias("headline"), F.nullif(F.regexp_extract(body, r"(?i)Serial Number:\s*(\d+)", 1), F.lit("")).alias("serial"))
    return rows.filter("headline IS NOT NULL")


@query("masked_urls", show("SELECT page_id, url || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 'api_key=REDACTED&x=1' AS url FROM pages", "page_id, url"))
def _(spark, d):
    p = table(spark, d, "pages")
    joined = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("api_key=s"), F.col("page_id").cast("string"), F.lit("&x=1"))
    return p.select("page_id", text.mask_query_secret(joined).alias("url"))


@query(
    "scope_value_from_text",
    show(
        "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN round(o_totalprice) / 10.0 WHEN o_custkey % 5 = 1 THEN 440.0 WHEN o_custkey % 5 = 2 THEN 3100.0 ELSE 10.0 END AS value FROM orders",
        "o_orderkey",
        "value",
    ),
)
def _(spark, d):
    k = F.col("o_custkey") % 5
    money = F.concat(F.lit("metals worth $"), F.format_number(F.round("o_totalprice") / 10.0, 1), F.lit("B"))
    scope = F.when(k == 0, money).when(k == 1, "All goods from China").when(k == 2, "universal tariff, china included").otherwise("China, electric vehicles")
    return table(spark, d, "orders").select("o_orderkey", text.scope_value(scope).alias("value"))


@query(
    "age_labels_to_bins",
    show(
        f"""SELECT o_orderkey, CASE WHEN k = 0 THEN 'M' WHEN k = 1 THEN 'F' END AS sex, CASE WHEN o_custkey % 7 = 6 THEN NULL WHEN o_custkey % 7 = 5 THEN '85+' WHEN o_custkey % 7 = 4 THEN '0-4' ELSE ({'[' + ', '.join(f"'{b}'" for b in STANDARD_BINS) + ']'})[a + 1] END AS bin
  FROM (SELECT o_orderkey, o_custkey, o_orderkey % 3 AS k, (o_orderkey % 17)::INT AS a FROM orders) AS t""",
        "o_orderkey, sex, bin",
    ),
)
def _(spark, d):
    a, c, k = (F.col("o_orderkey") % 17) * 5, F.col("o_custkey") % 7, F.col("o_orderkey") % 3
    s = lambda x: x.cast("int").cast("string")
    age = (
        F.when(c == 0, F.concat(s(a), F.lit(" to "), s(a + 4), F.lit(" years")))
        .when(c == 1, F.concat(s(a + 1), F.lit(" and "), s(a + 2), F.lit(" years")))
        .when(c == 2, F.concat(s(a + 3), F.lit(" years")))
        .when(c == 3, F.concat(s(a), F.lit(" through "), s(a + 2), F.lit(" years")))
        .when(c == 4, "Under 5 years")
        .when(c == 5, "85 years and over")
        .otherwise("18 to 64 years")
    )
    sex = F.when(k == 0, "Male:").when(k == 1, "Female:").otherwise("Total:")
    label = F.concat_ws("!!", F.lit(" "), F.lit("Total:"), sex, age)
    rows = table(spark, d, "orders").select("o_orderkey", label.alias("label"))
    return rows.select("o_orderkey", text.label_sex("label").alias("sex"), text.standard_bin(text.label_age("label"), STANDARD_BINS).alias("bin"))


@query(
    "label_tree_subtotals",
    show(
        "SELECT n_name AS unit, o_orderpriority AS kind, c_mktsegment AS leaf, count(*) AS n, sum(count(*)) OVER (PARTITION BY n_name, o_orderpriority)::BIGINT AS subtotal FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3",
        "unit, kind, leaf, n, subtotal",
    ),
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("unit"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    tree = rows.rollup("unit", "o_orderpriority", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    label = tree.withColumn("label", F.concat_ws("!!", "unit", "o_orderpriority", "c_mktsegment")).withColumn("parts", F.split("label", "!!"))
    subtotal = label.filter(F.size("parts") == 2).select("unit", "o_orderpriority", F.col("n").alias("subtotal"))
    leaf = label.filter(F.size("parts") == 3)
    return leaf.join(subtotal, ["unit", "o_orderpriority"]).select("unit", F.col("o_orderpriority").alias("kind"), F.col("c_mktsegment").alias("leaf"), "n", "subtotal")


@query(
    "band_resolution_class",
    show("SELECT c_nationkey AS unit, CASE WHEN bool_and(c_custkey % 97 <> 5) THEN 'fine' ELSE 'coarse' END AS resolution FROM customer GROUP BY 1", "unit, resolution"),
)
def _(spark, d):
    c = table(spark, d, "customer")
    label = F.when(F.col("c_custkey") % 97 == 5, "18 to 64 years").otherwise("20 to 24 years")
    rows = c.select(F.col("c_nationkey").alias("unit"), text.standard_bin(label, STANDARD_BINS).isNotNull().alias("fits"))
    return rows.groupBy("unit").agg(F.when(F.every("fits"), "fine").otherwise("coarse").alias("resolution"))


@query(
    "recode_bands",
    show(
        "SELECT c_custkey, coalesce(t.b, raw) AS band FROM (SELECT c_custkey, (['15-17', '18-19', '20', '21', '22-24', '60-61', '62-64', '65-66', '67-69', '85+'])[(c_custkey % 10)::INT + 1] AS raw FROM customer) AS c LEFT JOIN (VALUES "
        + ", ".join(f"('{a}', '{b}')" for a, b in FINE_BANDS.items())
        + ") AS t(a, b) ON t.a = raw",
        "c_custkey, band",
    ),
)
def _(spark, d):
    bands = F.array(*[F.lit(b) for b in [*FINE_BANDS, "85+"]])
    rows = table(spark, d, "customer").select("c_custkey", F.element_at(bands, (F.col("c_custkey") % 10 + 1).cast("int")).alias("band"))
    mapping = spark.createDataFrame(list(FINE_BANDS.items()), "a string, b string")
    return recode(rows, "band", mapping, "a", "b")


@query(
    "series_id_parts",
    show("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%04d', l_suppkey % 10000) AS area, 'SA' || l_linenumber AS item, strftime(l_shipdate, '%Y-%m') AS ym FROM lineitem WHERE day(l_shipdate) <> 13", "l_orderkey, l_linenumber, l_partkey, l_suppkey, area, item, ym"),
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    series = F.concat(F.lit("CUUR"), F.lpad((F.col("l_suppkey") % 10000).cast("string"), 4, "0"), F.lit("SA"), F.col("l_linenumber").cast("string"))
    period = F.when(F.dayofmonth("l_shipdate") == 13, "M13").otherwise(F.concat(F.lit("M"), F.date_format("l_shipdate", "MM")))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", series.alias("series"), F.year("l_shipdate").alias("year"), period.alias("period"))
    rows = rows.filter(text.monthly_period("period"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.series_area("series").alias("area"), text.series_item("series").alias("item"), F.concat_ws("-", F.col("year").cast("string"), F.substring("period", 2, 2)).alias("ym"))


@query(
    "month_label_arithmetic",
    show("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) - INTERVAL 14 MONTH, '%Y-%m') AS earlier, strftime(date_trunc('month', o_orderdate) + INTERVAL 23 MONTH, '%Y-%m') AS later FROM orders", "o_orderkey, earlier, later"),
)
def _(spark, d):
    ym = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, d, "orders").select("o_orderkey", calendar.shift_label(ym, -14).alias("earlier"), calendar.shift_label(ym, 23).alias("later"))


@query(
    "clock_normalisation",
    show(
        "SELECT event_id, strftime(timezone('UTC', timezone('America/New_York', ts)), '%Y-%m-%d %H:%M:%S') AS eastern, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS fixed, ts::DATE AS day FROM events",
        "event_id, eastern, fixed, day",
    ),
)
def _(spark, d):
    e = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return e.select(
        "event_id",
        F.date_format(calendar.wall_clock_to_utc(ts, "America/New_York"), fmt).alias("eastern"),
        F.date_format(calendar.fixed_offset_to_utc(ts, -5), fmt).alias("fixed"),
        calendar.compact_date(F.date_format("ts", "yyyyMMdd")).alias("day"),
    )


@query(
    "epiweek_end",
    show(
        "SELECT o_orderkey, (j4 - dow::INT + ((wk - 1) * 7 + 6)::INT)::DATE AS week_end FROM (SELECT o_orderkey, (o_orderkey % 52 + 1)::INT AS wk, make_date(year(o_orderdate), 1, 4) AS j4, dayofweek(make_date(year(o_orderdate), 1, 4)) AS dow FROM orders) AS t",
        "o_orderkey, week_end",
    ),
)
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", calendar.epiweek_saturday(F.year("o_orderdate"), F.col("o_orderkey") % 52 + 1).alias("week_end"))


@query(
    "rounding_modes",
    show("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / 4, 1) AS half_even, round(l_quantity / 4, 1) AS half_away, floor(l_quantity / 4 * 10 + 0.5) / 10 AS half_up FROM lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey", "half_even, half_away, half_up"),
)
def _(spark, d):
    x = F.col("l_quantity") / 4
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", stats.half_even(x, 1).alias("half_even"), stats.half_away(x, 1).alias("half_away"), stats.half_up(x, 1).alias("half_up"))


@query(
    "orbit_and_size_formulas",
    show(
        "SELECT event_id, cbrt(398600.4418 / pow(n, 2)) - 6378.137 AS altitude, round(3550900 * pow(10, -h / 5)) AS diameter, value / 1000 / (384400.0 / 149597870.7) AS lunar FROM (SELECT event_id, value, (14 + value / 400) * 2 * pi() / 86400 AS n, 18 + value / 100 AS h FROM events) AS t",
        "event_id",
        "altitude, diameter, lunar",
    ),
)
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", stats.altitude_km(v / 400 + 14).alias("altitude"), stats.diameter_m(v / 100 + 18).alias("diameter"), stats.lunar_distances(v / 1000).alias("lunar"))


@query(
    "flux_class_letters",
    show(
        "SELECT event_id, l || CASE WHEN s >= 10 THEN printf('%.0f', s) ELSE printf('%.1f', s) END AS cls, CASE l WHEN 'X' THEN CASE WHEN s >= 10 THEN 'critical' ELSE 'serious' END WHEN 'M' THEN CASE WHEN round(s, 1) >= 5 THEN 'serious' ELSE 'warning' END ELSE 'info' END AS severity FROM (SELECT event_id, l, f / b AS s FROM (SELECT event_id, f, CASE WHEN f >= 1e-4 THEN 'X' WHEN f >= 1e-5 THEN 'M' WHEN f >= 1e-6 THEN 'C' WHEN f >= 1e-7 THEN 'B' ELSE 'A' END AS l, CASE WHEN f >= 1e-4 THEN 1e-4 WHEN f >= 1e-5 THEN 1e-5 WHEN f >= 1e-6 THEN 1e-6 WHEN f >= 1e-7 THEN 1e-7 ELSE 1e-8 END AS b FROM (SELECT event_id, (event_id % 7 + 1.3) * pow(10, -8 + (user_id % 6)::INT) AS f FROM events) AS a) AS q) AS t",
        "event_id, cls, severity",
    ),
)
def _(spark, d):
    f = (F.col("event_id") % 7 + 1.3) * F.pow(F.lit(10.0), (F.col("user_id") % 6) - 8)
    rows = table(spark, d, "events").select("event_id", stats.log_class(f).alias("cls"))
    return rows.withColumn("severity", walls.severity_by_class("cls"))


@query(
    "implied_probabilities",
    show(
        "SELECT event_id, CASE WHEN bid > 0 OR ask < 1 THEN (bid + ask) / 2 WHEN last > 0 THEN last END AS p, CASE WHEN user_id % 3 = 0 THEN -25.0 WHEN user_id % 3 = 1 THEN 50.0 END AS bps FROM (SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 0 ELSE least(value, 100) / 200 END AS bid, CASE WHEN event_type = 'view' THEN 1 ELSE 0.9 END AS ask, CASE WHEN event_type = 'view' AND value > 30 THEN 0.4 ELSE 0 END AS last FROM events) AS t",
        "event_id",
        "p, bps",
    ),
)
def _(spark, d):
    e = table(spark, d, "events")
    quiet = F.col("event_type") == "view"
    bid = F.when(quiet, 0.0).otherwise(F.least("value", F.lit(100.0)) / 200)
    ask = F.when(quiet, 1.0).otherwise(0.9)
    last = F.when(quiet & (F.col("value") > 30), 0.4).otherwise(0.0)
    k = F.col("user_id") % 3
    kind = F.when(k == 0, "Cut").when(k == 1, "Hike")
    strike = F.when(k == 0, "25").otherwise(">25")
    return e.select("event_id", stats.implied_probability(bid, ask, last).alias("p"), text.strike_basis_points(kind, strike).alias("bps"))


@query("cadence_milliseconds", show("SELECT doc_id, (n_chars % 50 + 1) * CASE lang WHEN 'en' THEN 60000 WHEN 'de' THEN 3600000 WHEN 'fr' THEN 86400000 ELSE 604800000 END AS ms FROM documents", "doc_id, ms"))
def _(spark, d):
    unit = F.when(F.col("lang") == "en", "m").when(F.col("lang") == "de", "h").when(F.col("lang") == "fr", "d").otherwise("w")
    return table(spark, d, "documents").select("doc_id", calendar.cadence_millis(F.concat((F.col("n_chars") % 50 + 1).cast("string"), unit)).alias("ms"))


@query(
    "stage_from_footnote",
    show("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'final' WHEN 'N' THEN 'initial' ELSE 'unknown' END AS stage FROM lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey, stage"),
)
def _(spark, d):
    # Footnote codes of the publication stages
    stages = {"": "final", "I": "initial", "U": "interim"}
    note = F.when(F.col("l_returnflag") == "A", " ").when(F.col("l_returnflag") == "N", "I").otherwise("Z")
    table_ = F.create_map(*[F.lit(x) for kv in stages.items() for x in kv])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.try_element_at(table_, F.trim(note)), F.lit("unknown")).alias("stage"))


@query(
    "severity_by_enum",
    show("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'serious' WHEN '3-MEDIUM' THEN 'warning' ELSE 'info' END AS severity FROM orders", "o_orderkey, severity"),
)
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", walls.severity_by_enum("o_orderpriority", {"1-URGENT": "critical", "2-HIGH": "serious", "3-MEDIUM": "warning"}).alias("severity"))


@query(
    "event_family_labels",
    show(
        "SELECT grp, label, CASE WHEN n >= 3 THEN 'sec_' || k ELSE label END AS family FROM (SELECT grp, 'sec_' || k || '_' || s AS label, k, count(*) OVER (PARTITION BY grp, k) AS n FROM (SELECT DISTINCT c_nationkey AS grp, c_mktsegment AS s, c_custkey % 5 AS k FROM customer) AS t) AS q",
        "grp, label, family",
    ),
)
def _(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_nationkey").alias("grp"), F.concat_ws("_", F.lit("sec"), (F.col("c_custkey") % 5).cast("string"), "c_mktsegment").alias("label")).distinct()
    # kin are counted per (group, prefix), so no list of labels is carried
    prefix = F.substring_index("label", "_", 2)
    kin = rows.groupBy("grp", prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    return rows.withColumn("_p", prefix).join(kin, ["grp", "_p"]).select("grp", "label", F.when(F.col("_n") >= 3, F.col("_p")).otherwise(F.col("label")).alias("family"))


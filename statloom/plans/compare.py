"""Peer and cross-source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions.text import place_key
from statloom.operators import compare, ledger, peers, spans
from statloom.operators.ordered import exact_quantiles, shared, written
from statloom.plans.ledger import METRICS, STAFF, _excl, directory, items, metrics, staff
from statloom.plans.registry import query, show
from statloom.plans.tables import cents, table
from statloom.session import scratch_folder
from statloom.sources import checked

PEERS = """
u AS (SELECT c_custkey AS pid, c_acctbal + 1100 AS pop, CASE WHEN c_nationkey % 5 <> 0 THEN 90.0 + c_nationkey END AS rpp,
  c_mktsegment = 'BUILDING' AS consolidated_or_independent, c_mktsegment = 'MACHINERY' AS runs_schools, c_nationkey < 3 AS fire_external,
  c_acctbal < 0 AS police_contracted, c_nationkey > 20 AS county_like_functions, c_acctbal > -500 AS complete FROM customer),
"""
_W = {"consolidated_or_independent": 1.5, "runs_schools": 1.5, "fire_external": 1.5, "police_contracted": 1.5, "county_like_functions": 1.0}


def _peer_sql(w=None, size=1.0, scale=10.0):
    w = w or _W
    struct = " + ".join(f"CASE WHEN a.{k} <> b.{k} THEN {v} ELSE 0 END" for k, v in w.items())
    names = ", ".join(f"CASE WHEN a.{k} <> b.{k} THEN '{k}' END" for k in w)
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(distance, 9), peer_pid) AS rank FROM (
  SELECT *, s + size_component + price_component AS distance FROM (
   SELECT a.pid, b.pid AS peer_pid, {struct} AS s, concat_ws('|', {names}) AS structure_mismatches,
    abs(log2(a.pop) * {size} - log2(b.pop) * {size}) AS size_component, coalesce(abs(a.rpp / {scale} - b.rpp / {scale}), 1.0) AS price_component
   FROM u a JOIN u b ON a.pid <> b.pid AND b.complete) AS q) AS q2) AS q3 WHERE rank <= 8"""


def peer_units(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("pid"),
        (F.col("c_acctbal") + 1100).alias("pop"),
        F.when(F.col("c_nationkey") % 5 != 0, F.lit(90.0) + F.col("c_nationkey")).alias("rpp"),
        (F.col("c_mktsegment") == "BUILDING").alias("consolidated_or_independent"),
        (F.col("c_mktsegment") == "MACHINERY").alias("runs_schools"),
        (F.col("c_nationkey") < 3).alias("fire_external"),
        (F.col("c_acctbal") < 0).alias("police_contracted"),
        (F.col("c_nationkey") > 20).alias("county_like_functions"),
        (F.col("c_acctbal") > -500).alias("complete"),
    )


@query(
    "peer_groups",
    show(_peer_sql(), "pid, rank, peer_pid, structure_mismatches", "distance, size_component, price_component", PEERS),
)
def _(spark, d):
    return peers.nearest_peers(peer_units(spark, d))


@query(
    "peer_group_quality",
    show(
        f"""SELECT pid, n_peers, um AS upper_median, CASE WHEN um >= 3 OR am THEN 'weak' WHEN um < 1.5 THEN 'close' ELSE 'loose' END AS group_quality FROM (
  SELECT pid, count(*) AS n_peers, list_extract(list(distance ORDER BY distance), count(*) // 2 + 1) AS um, bool_and(structure_mismatches <> '') AS am FROM ({_peer_sql()}) GROUP BY 1) AS z""",
        "pid, n_peers, group_quality",
        "upper_median",
        PEERS,
    ),
)
def _(spark, d):
    return peers.group_quality(peers.nearest_peers(peer_units(spark, d)))


_ALT = {k: v * 1.5 for k, v in _W.items()}


@query(
    "peer_weight_sensitivity",
    show(
        f"""SELECT scenario, list_extract(list(o ORDER BY o), count(*) // 2 + 1) AS upper_median, avg(o) AS mean, count(*) AS n FROM (
  SELECT 'structure x1.5' AS scenario, a.pid, len(list_intersect(pa, pb)) / 8.0 AS o FROM (SELECT pid, list(peer_pid) AS pa FROM ({_peer_sql()}) GROUP BY 1) AS a
    JOIN (SELECT pid, list(peer_pid) AS pb FROM ({_peer_sql(_ALT)}) GROUP BY 1) AS b USING (pid)
  UNION ALL SELECT 'price scale 20', a.pid, len(list_intersect(pa, pb)) / 8.0 FROM (SELECT pid, list(peer_pid) AS pa FROM ({_peer_sql()}) GROUP BY 1) AS a
    JOIN (SELECT pid, list(peer_pid) AS pb FROM ({_peer_sql(None, 1.0, 20.0)}) GROUP BY 1) AS b USING (pid)) AS t GROUP BY 1""",
        "scenario, n",
        "upper_median, mean",
        PEERS,
    ),
)
def _(spark, d):
    units = peer_units(spark, d)
    base = shared(peers.nearest_peers(units))
    runs = {"structure x1.5": peers.nearest_peers(units, weights=_ALT), "price scale 20": peers.nearest_peers(units, price_scale=20.0)}
    rows = None
    for name, other in runs.items():
        part = peers.peer_overlap(base, other).withColumn("scenario", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    rows = shared(rows)
    med = exact_quantiles(rows, "scenario", "overlap", {"upper_median": 0.5}, "upper")
    return med.join(rows.groupBy("scenario").agg(F.avg("overlap").alias("mean")), "scenario")


NAMES = """
census AS (SELECT p_name AS city, p_brand AS state, sum(l_quantity)::BIGINT AS sworn FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'A' GROUP BY 1, 2),
fbi AS (SELECT upper(replace(p_name, ' ', '-')) || ' City' AS city, p_brand AS state, sum(l_quantity)::BIGINT AS officers FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'N' GROUP BY 1, 2),
matched AS (SELECT c.city, c.state, c.sworn, f.officers, c.sworn * 1.0 / f.officers AS ratio FROM census c JOIN fbi f ON f.state = c.state
  AND regexp_replace(regexp_replace(lower(f.city), ' city$', ''), '[^a-z]', '', 'g') = regexp_replace(lower(c.city), '[^a-z]', '', 'g')),
"""


def name_sources(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    parts = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_brand").alias("state"))
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey)
    sums = shared(rows.groupBy("p_name", "state", "l_returnflag").agg(F.sum("l_quantity").cast("bigint").alias("q")))
    census = sums.filter("l_returnflag <> 'A'").groupBy(F.col("p_name").alias("city"), "state").agg(F.sum("q").alias("sworn"))
    shouted = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit(" City"))
    fbi = sums.filter("l_returnflag <> 'N'").groupBy(shouted.alias("agency"), "state").agg(F.sum("q").alias("officers"))
    return census, fbi


def matched_names(spark, d):
    census, fbi = name_sources(spark, d)
    joined = census.withColumn("key", place_key("city")).join(fbi.withColumn("key", place_key("agency")), ["key", "state"])
    return joined.select("city", "state", "sworn", "officers", (F.col("sworn") / F.col("officers")).alias("ratio"))


@query("normalised_name_join", show("SELECT * FROM matched", "city, state, sworn, officers", "ratio", NAMES))
def _(spark, d):
    return matched_names(spark, d)


def _summary_sql(source, group, ratio="ratio"):
    return f"""SELECT {group}, n, exact, {_excl(0.25)} AS q1, {_excl(0.5)} AS median, {_excl(0.75)} AS q3, within5, within10, within20, within25 FROM (
  SELECT {group}, count(*) AS n, list({ratio} ORDER BY {ratio}) AS v, count(*) FILTER (WHERE {ratio} = 1) AS exact,
  {', '.join(f"100 * avg(CASE WHEN abs({ratio} - 1) <= {w / 100} THEN 1.0 ELSE 0 END) AS within{w}" for w in (5, 10, 20, 25))}
  FROM {source} WHERE {ratio} IS NOT NULL AND {ratio} <> 0 GROUP BY 1) AS t"""


@query("cross_source_ratio_summary", show(_summary_sql("matched", "state"), "state, n, exact", "q1, median, q3, within5, within10, within20, within25", NAMES))
def _(spark, d):
    return compare.ratio_summary(matched_names(spark, d), "state", "ratio")


@query(
    "closest_year_ratio",
    show(
        """SELECT unit, year, o AS "offset", r AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY unit, year ORDER BY abs(r - 1), o) AS k FROM (
  SELECT a.unit, a.year, b.year - a.year AS o, a.police_usd * 1.0 / b.fire_usd AS r FROM metrics a JOIN metrics b ON b.unit = a.unit AND b.year IN (a.year, a.year + 1) WHERE b.fire_usd <> 0) AS t) AS q WHERE k = 1""",
        'unit, year, "offset"',
        "ratio",
        METRICS,
    ),
)
def _(spark, d):
    rows = metrics(spark, d)
    return compare.closest_year(rows.select("unit", "year", "police_usd"), rows.select("unit", "year", "fire_usd"), ["unit"], "year", "police_usd", "fire_usd")


@query(
    "prefer_own_rows",
    show(
        """SELECT unit, year, police_usd AS usd, 'own' AS source FROM metrics WHERE year >= 1998 AND unit IN (SELECT unit FROM big)
  UNION ALL SELECT unit, year, pop, 'external' FROM directory d WHERE unit IN (SELECT unit FROM big) AND NOT EXISTS (SELECT 1 FROM metrics m WHERE m.unit = d.unit AND m.year = d.year AND m.year >= 1998)""",
        "unit, year, usd, source",
        "",
        METRICS + "big AS (SELECT unit FROM directory GROUP BY 1 HAVING max(pop) >= 110000),",
    ),
)
def _(spark, d):
    places = directory(spark, d)
    ours = metrics(spark, d).filter("year >= 1998").select("unit", "year", F.col("police_usd").alias("usd"))
    theirs = places.select("unit", "year", F.col("pop").alias("usd"))
    return compare.prefer_ours(ours, theirs, ["unit", "year"], ledger.universe(places, 110_000), "unit")


@query(
    "state_aggregate_reconciliation",
    show(
        """SELECT state, arg_max(level, hits * 10 + CASE level WHEN 'b' THEN 1 ELSE 0 END) AS level, max(hits) AS hits FROM (
  SELECT p.state, p.level, count(*) FILTER (WHERE p.amount = o.amount) AS hits FROM pub p LEFT JOIN ours o ON o.state = p.state AND o.code = p.code GROUP BY 1, 2) AS t GROUP BY 1""",
        "state, level, hits",
        "",
        METRICS
        + """
sc AS (SELECT n_name AS state, code, year, amount FROM items JOIN supplier ON s_suppkey = unit JOIN nation ON n_nationkey = s_nationkey),
ours AS (SELECT state, code, sum(amount)::BIGINT AS amount FROM sc GROUP BY 1, 2),
pub AS (SELECT 'a' AS level, state, code, sum(amount)::BIGINT AS amount FROM sc WHERE NOT (code LIKE 'E%' AND year = 1999) GROUP BY 1, 2, 3
  UNION ALL SELECT 'b', state, code, sum(amount)::BIGINT FROM sc WHERE NOT (code LIKE '%2' AND year = 1997) GROUP BY 1, 2, 3),""",
    ),
)
def _(spark, d):
    places = directory(spark, d).select("unit", "state").distinct()
    sc = shared(items(spark, d).join(places, "unit").groupBy("state", "code", "year").agg(F.sum("amount").alias("amount")))
    ours = sc.groupBy("state", "code").agg(F.sum("amount").alias("_ours"))
    a = sc.filter(~((F.substring("code", 1, 1) == "E") & (F.col("year") == 1999))).withColumn("level", F.lit("a"))
    b = sc.filter(~((F.substring("code", 3, 1) == "2") & (F.col("year") == 1997))).withColumn("level", F.lit("b"))
    published = a.unionByName(b).groupBy("level", "state", "code").agg(F.sum("amount").alias("amount"))
    hits = published.join(ours, ["state", "code"], "left").groupBy("state", "level").agg(F.count_if(F.col("amount") == F.col("_ours")).alias("hits"))
    return hits.groupBy("state").agg(F.max_by("level", F.struct("hits", "level")).alias("level"), F.max("hits").alias("hits"))


@query(
    "level_reconciliation_totals",
    show(
        """SELECT level, count(*) AS cells, count(*) FILTER (WHERE p.amount = o.amount) AS hits FROM (SELECT 'a' AS level, unit, year, police_usd AS amount FROM metrics UNION ALL
  SELECT 'b', unit, year, police_usd + CASE WHEN police_usd > 2000000000 THEN 1 ELSE 0 END FROM metrics) AS p LEFT JOIN metrics m ON m.unit = p.unit AND m.year = p.year
  LEFT JOIN LATERAL (SELECT m.police_usd AS amount) AS o ON true GROUP BY 1""",
        "level, cells, hits",
        "",
        METRICS,
    ),
)
def _(spark, d):
    ours = metrics(spark, d).select("unit", "year", F.col("police_usd").alias("amount"))
    bumped = ours.withColumn("amount", F.col("amount") + F.when(F.col("amount") > 2_000_000_000, 1).otherwise(0))
    published = ours.withColumn("level", F.lit("a")).unionByName(bumped.withColumn("level", F.lit("b")))
    return compare.reconcile_levels(ours, published, ["unit", "year"])


@query(
    "employment_reconciliation",
    show(
        """SELECT state, code, sum(ft)::BIGINT AS ours, sum(qty)::BIGINT AS published, sum(ft)::BIGINT = sum(qty)::BIGINT AS exact FROM (
  SELECT n_name AS state, code, ft, CASE WHEN code = '062' AND year = 2000 THEN ft + 1 ELSE ft END AS qty FROM staff JOIN supplier ON s_suppkey = unit JOIN nation ON n_nationkey = s_nationkey WHERE code <> '999') AS t GROUP BY 1, 2""",
        "state, code, ours, published, exact",
        "",
        STAFF,
    ),
)
def _(spark, d):
    places = directory(spark, d).select("unit", "state").distinct()
    rows = staff(spark, d).filter("code <> '999'").join(places, "unit")
    pub = F.sum(F.col("ft") + F.when((F.col("code") == "062") & (F.col("year") == 2000), 1).otherwise(0))
    return rows.groupBy("state", "code").agg(F.sum("ft").alias("ours"), pub.alias("published"), (F.sum("ft") == pub).alias("exact"))


_BEFORE_AFTER = """
st AS (SELECT year, police_pct_general AS b, police_pct_core AS a FROM metrics WHERE police_pct_general IS NOT NULL AND police_pct_core IS NOT NULL),
hs AS (SELECT year || ' median police share' AS stat, median(b) AS before, median(a) AS after FROM st GROUP BY year
  UNION ALL SELECT year || ' shares within 20', 100.0 * count(*) FILTER (WHERE b <= 20) / count(*), 100.0 * count(*) FILTER (WHERE a <= 20) / count(*) FROM st GROUP BY year),
"""


@query(
    "worse_headlines",
    show("SELECT * FROM hs WHERE after < before - CASE WHEN stat LIKE '%within%' THEN 0.5 ELSE 0 END", "stat", "before, after", METRICS + _BEFORE_AFTER),
)
def _(spark, d):
    """Yearly headline figures of two ways of stating the police share, the first being the baseline."""
    rows = shared(metrics(spark, d).filter("police_pct_general IS NOT NULL AND police_pct_core IS NOT NULL"))

    def headlines(value):
        medians = exact_quantiles(rows, "year", value, {"value": 0.5}).select(F.concat_ws(" ", "year", F.lit("median police share")).alias("stat"), "value")
        shares = rows.groupBy("year").agg((F.count_if(F.col(value) <= 20) * 100.0 / F.count(F.lit(1))).alias("value"))
        return medians.unionByName(shares.select(F.concat_ws(" ", "year", F.lit("shares within 20")).alias("stat"), "value"))

    return compare.worse_headlines(headlines("police_pct_general"), headlines("police_pct_core"))


@query(
    "history_drift",
    show(
        """SELECT unit, year, a.police_pct_general AS before, b.police_pct_core AS after, b.police_pct_core - a.police_pct_general AS moved FROM metrics a JOIN metrics b USING (unit, year)
  WHERE abs(b.police_pct_core - a.police_pct_general) > 12.505""",
        "unit, year",
        "before, after, moved",
        METRICS,
    ),
)
def _(spark, d):
    rows = metrics(spark, d)
    old = rows.select("unit", "year", F.col("police_pct_general").alias("v"))
    new = rows.select("unit", "year", F.col("police_pct_core").alias("v"))
    return compare.drift(old, new, ["unit", "year"], "v", 12.505)


@query(
    "majority_metro",
    show(
        """SELECT place, top, total - best AS disagree FROM (SELECT place, first(metro ORDER BY n DESC, metro) AS top, sum(n)::BIGINT AS total, max(n) AS best FROM (
  SELECT l_suppkey AS place, c_nationkey AS metro, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) AS t GROUP BY 1) AS q""",
        "place, top, disagree",
    ),
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("place"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    people = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("metro"))
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return compare.majority(rows.select("place", "metro"), "place", "metro")


DOCS = """
docset AS (SELECT * FROM (SELECT l_suppkey AS city, l_shipmode.f AS framing, l_orderkey, l_linenumber, l_extendedprice / (1000 * l_quantity) AS ratio
   FROM (SELECT *, {'f': CASE l_returnflag WHEN 'A' THEN 'all_funds' WHEN 'N' THEN 'general_fund' ELSE 'department' END} AS l_shipmode FROM lineitem)) AS t
   WHERE framing LIKE 'general_fund%' OR framing LIKE 'all_funds%' QUALIFY row_number() OVER (PARTITION BY city ORDER BY l_orderkey, l_linenumber, ratio) = 1),
"""


@query(
    "document_ratio_set",
    show(
        f"""SELECT n, {_excl(0.25)} AS q1, {_excl(0.5)} AS median, {_excl(0.75)} AS q3, within20 FROM (SELECT count(*) AS n, list(ratio ORDER BY ratio) AS v, 100 * avg(CASE WHEN abs(ratio - 1) <= 0.2 THEN 1.0 ELSE 0 END) AS within20 FROM docset) AS t""",
        "n",
        "q1, median, q3, within20",
        DOCS,
    ),
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("city"),
        F.when(F.col("l_returnflag") == "A", "all_funds").when(F.col("l_returnflag") == "N", "general_fund").otherwise("department").alias("framing"),
        "l_orderkey",
        "l_linenumber",
        (F.col("l_extendedprice") / (F.col("l_quantity") * 1000)).alias("ratio"),
    )
    accepted = F.col("framing").startswith("general_fund") | F.col("framing").startswith("all_funds")
    first = compare.first_accepted(lines, "city", accepted, ["l_orderkey", "l_linenumber", "ratio"])
    return compare.ratio_summary(first.withColumn("all", F.lit(1)), "all", "ratio").select("n", "q1", "median", "q3", "within20")


@query(
    "own_books_vs_residents_bill",
    show(
        """SELECT a.unit, a.year, a.police_pct_general AS own_books, 100.0 * b.police_usd / nullif(b.total_expenditure_usd + b.police_intergov_usd, 0) AS residents_bill,
  a.police_pct_general - 100.0 * b.police_usd / nullif(b.total_expenditure_usd + b.police_intergov_usd, 0) AS gap FROM metrics a JOIN metrics b USING (unit, year) WHERE a.police_pct_general IS NOT NULL""",
        "unit, year",
        "own_books, residents_bill, gap",
        METRICS,
    ),
)
def _(spark, d):
    rows = metrics(spark, d)
    bill = F.col("police_usd") * 100 / F.nullif(F.col("total_expenditure_usd") + F.col("police_intergov_usd"), F.lit(0))
    out = rows.filter("police_pct_general IS NOT NULL").select("unit", "year", F.col("police_pct_general").alias("own_books"), bill.alias("residents_bill"))
    return out.withColumn("gap", F.col("own_books") - F.col("residents_bill"))


@query(
    "ambiguous_name_resolution",
    show(
        """SELECT name, code, p = 0 AS parent_matched, candidates FROM (SELECT p_name AS name, count(*) OVER (PARTITION BY p_name) AS candidates, p_partkey AS code,
    CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) THEN 0 ELSE 1 END AS p FROM part) AS t
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY p, code) = 1""",
        "name, code, parent_matched, candidates",
    ),
)
def _(spark, d):
    parts = table(spark, d, "part")
    items_ = parts.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("code"), F.col("p_brand").alias("parent"))
    return compare.resolve_names(items_.select("name").distinct(), items_, parts.filter("p_size = 50").select(F.col("p_brand").alias("code")))


@query(
    "validation_log",
    show(
        """SELECT 'orders total' AS check_name, year::VARCHAR AS key, a.ours, b.published, a.ours - b.published AS diff, abs(a.ours - b.published) <= 100000 AS ok FROM (
  SELECT year(o_orderdate) AS year, sum(round(o_totalprice * 100)::BIGINT) / 100.0 AS ours FROM orders GROUP BY 1) AS a JOIN (
  SELECT year(o_orderdate) AS year, sum(round(o_totalprice)::BIGINT)::DOUBLE AS published FROM orders WHERE o_orderstatus <> 'P' OR year(o_orderdate) > 1996 GROUP BY 1) AS b USING (year)""",
        "check_name, key, ok",
        "",
        "",
        "ours, published, diff",
    ),
)
def _(spark, d):
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    ours = orders.groupBy("year").agg((F.sum(cents("o_totalprice")) / 100.0).alias("ours"))
    pub = orders.filter("o_orderstatus <> 'P' OR year > 1996").groupBy("year").agg(F.sum(F.round("o_totalprice").cast("bigint")).cast("double").alias("published"))
    rows = compare.check_rows(ours.join(pub, "year"), "orders total", F.col("year").cast("string"), "ours", "published", 100_000)
    return rows.withColumns({c: F.round(c, 2) for c in ("ours", "published", "diff")})


@query(
    "figure_drift",
    show(
        """SELECT name, shown, value, abs(value - shown::DOUBLE) <= 0.05 AS ok FROM (SELECT n_name AS name, printf('%.1f', avg(c_acctbal) FILTER (WHERE c_mktsegment <> 'MACHINERY')) AS shown, avg(c_acctbal) AS value
  FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) AS t""",
        "name, shown, ok",
        "value",
    ),
)
def _(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name"))
    both = shared(rows.agg(F.avg(F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal"))).alias("s"), F.avg("c_acctbal").alias("value")))
    bindings = both.select("name", F.format_string("%.1f", "s").alias("shown"), F.lit(None).cast("double").alias("tolerance"))
    return compare.figure_drift(bindings, both.select("name", "value"))


@query(
    "population_cross_check",
    show(
        """SELECT n_name AS area, a.n AS ours, b.n AS other, abs(a.n - b.n) * 1.0 / b.n AS rel, abs(a.n - b.n) * 1.0 / b.n <= 0.02 AS ok FROM nation
  JOIN (SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) AS a ON a.c_nationkey = n_nationkey
  JOIN (SELECT c_nationkey, count(*) * 10 AS n FROM customer GROUP BY 1) AS b ON b.c_nationkey = n_nationkey""",
        "area, ours, other, ok",
        "rel",
    ),
)
def _(spark, d):
    people = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    a = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("ours"))
    b = people.groupBy("c_nationkey").agg((F.count(F.lit(1)) * 10).alias("other"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("area"))
    rel = F.abs(F.col("ours") - F.col("other")) / F.col("other")
    return a.join(b, "c_nationkey").join(names, "c_nationkey").select("area", "ours", "other", rel.alias("rel"), (rel <= 0.02).alias("ok"))


@query(
    "source_change_detection",
    show(
        """SELECT coalesce(c.source, s.source) AS source, CASE WHEN coalesce(failed, true) THEN s.fp ELSE c.fp END AS fingerprint,
  CASE WHEN NOT coalesce(failed, true) AND c.fp IS DISTINCT FROM s.fp THEN '2024-02-01' ELSE s.changed END AS changed, NOT coalesce(failed, true) AND c.fp IS DISTINCT FROM s.fp AS is_changed
  FROM (SELECT source, sum(n_chars)::BIGINT AS fp, source = 'src3' AS failed FROM documents WHERE source <> 'src7' GROUP BY 1) AS c
  FULL JOIN (SELECT source, sum(n_chars)::BIGINT AS fp, '2024-01-01' AS changed FROM documents WHERE source <> 'src9' AND NOT (source = 'src5' AND lang = 'fr') GROUP BY 1) AS s ON s.source = c.source""",
        "source, fingerprint, changed, is_changed",
    ),
)
def _(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", "n_chars")
    fp = F.sum("n_chars").alias("fingerprint")
    now = docs.filter("source <> 'src7'").groupBy("source").agg(fp).withColumn("seen", F.lit("2024-02-01")).withColumn("failed", F.col("source") == "src3")
    old = docs.filter("source <> 'src9' AND NOT (source = 'src5' AND lang = 'fr')").groupBy("source").agg(fp).withColumn("changed", F.lit("2024-01-01"))
    return compare.changed_sources(now, old)


# months of heavy buying of a brand and line number as bands, the days from an order's first to its last shipment as spans
BANDS = """
days AS (SELECT lineitem.*, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day FROM lineitem),
bands AS (SELECT p_brand || '-' || l_linenumber AS band, min(day) AS blo, CASE WHEN l_linenumber < 7 THEN max(day) END AS bhi FROM days JOIN part ON p_partkey = l_partkey WHERE l_discount = 0.1 AND l_quantity >= 45 GROUP BY 1, l_linenumber),
trips AS (SELECT l_orderkey, min(day) AS lo, max(day) AS hi FROM days GROUP BY 1),
"""


@query(
    "range_containment_join",
    show("SELECT band, count(*) AS n, min(hi - lo) AS shortest, max(hi - lo) AS longest FROM trips JOIN bands ON blo <= lo AND (bhi IS NULL OR hi <= bhi) GROUP BY 1", "band, n, shortest, longest", "", BANDS),
)
def _(spark, d):
    lines = table(spark, d, "lineitem")
    day = F.unix_date(F.col("l_shipdate").cast("date"))
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    heavy = lines.filter("l_discount = 0.1 AND l_quantity >= 45").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    bands = heavy.groupBy(F.concat_ws("-", "p_brand", F.col("l_linenumber").cast("string")).alias("band"), "l_linenumber").agg(F.min(day).alias("band_lo"), F.max(day).alias("_last"))
    bands = bands.select("band", "band_lo", F.when(F.col("l_linenumber") < 7, F.col("_last")).alias("band_hi"))
    trips = lines.groupBy("l_orderkey").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    width = F.col("hi") - F.col("lo")
    return spans.containing_bands(trips, bands).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(width).alias("shortest"), F.max(width).alias("longest"))


_STAFF_CHECKS = """
SELECT 'rows' AS check_name, count(*)::DOUBLE AS measured, (SELECT count(*) FROM supplier) * 5.0 AS low, NULL::DOUBLE AS high FROM st
UNION ALL SELECT 'codes', count(DISTINCT code), 6, 6 FROM st
UNION ALL SELECT 'no pay below zero', count(*) FILTER (WHERE ft_pay < 0), 0, 0 FROM st
UNION ALL SELECT 'total staff', sum(ft), (SELECT sum(l_quantity) FROM lineitem), (SELECT sum(l_quantity) FROM lineitem) FROM st
UNION ALL SELECT 'staffed rows only', count(*) FILTER (WHERE ft < 10), 0, 0 FROM st
"""


@query(
    "checked_write_log",
    show("SELECT *, measured IS NOT NULL AND coalesce(measured >= low, true) AND coalesce(measured <= high, true) AS ok FROM (" + _STAFF_CHECKS + ") AS c", "check_name, ok", "measured, low, high", STAFF.replace("staff AS", "st AS")),
)
def _(spark, d):
    """The staff table through a checked write: what was measured on the way; a check that fails leaves no table."""
    lines = table(spark, d, "lineitem")
    total = float(lines.agg(F.sum("l_quantity")).first()[0] or 0)
    units = table(spark, d, "supplier").count()
    checks = [
        checked.Check("rows", F.count(F.lit(1)), low=units * 5),
        checked.exactly("codes", F.size(F.collect_set("code")), 6),
        checked.none_where("no pay below zero", F.col("ft_pay") < 0),
        checked.exactly("total staff", F.sum("ft"), total),
        checked.none_where("staffed rows only", F.col("ft") < 10),
    ]
    folder = scratch_folder(spark, "checked")
    return checked.log_rows(spark, checked.checked_write(staff(spark, d), folder, checks, required=["unit", "ft"], refuse=False))


@query(
    "restricted_columns_strip",
    show(
        """SELECT mktsegment, count(*) AS n, count(DISTINCT nation) AS nations FROM (SELECT c_mktsegment AS mktsegment, c_nationkey AS nation FROM customer) AS c GROUP BY 1""",
        "mktsegment, n, nations",
    ),
)
def _(spark, d):
    """Customers written without their restricted columns, read back: names and balances are gone, or nothing is written."""
    folder = scratch_folder(spark, "stripped")
    people = table(spark, d, "customer")
    private = [c for c in people.columns if c in ("c_name", "c_address", "c_phone", "c_acctbal", "c_comment")]
    checked.checked_write(people, folder, [checked.none_where("every customer has a key", F.col("c_custkey").isNull())], required=["c_custkey", "c_nationkey"], restricted=private)
    rows = spark.read.parquet(folder)
    if set(private) & set(rows.columns):
        raise ValueError("a restricted column was written")
    return rows.groupBy(F.col("c_mktsegment").alias("mktsegment")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("nations"))


_REQUIRED = {"orders": ["o_orderkey", "o_custkey", "o_orderdate", "o_paid"], "customer": ["c_custkey", "c_nationkey", "c_birthday"], "events": ["event_id", "ts"]}


@query(
    "required_columns_check",
    show(
        "SELECT w.t AS table_name, w.c AS column_name, k.column_name IS NOT NULL AS present FROM (VALUES "
        + ", ".join(f"('{t}', '{c}')" for t, cs in _REQUIRED.items() for c in cs)
        + ") AS w(t, c) LEFT JOIN information_schema.columns k ON k.table_name = w.t AND k.column_name = w.c",
        "table_name, column_name, present",
    ),
)
def _(spark, d):
    return checked.column_report({t: table(spark, d, t) for t in _REQUIRED}, _REQUIRED, spark)


@query(
    "table_digest_changes",
    show(
        """SELECT coalesce(a.part, b.part) AS part, a.n AS n_rows, b.n AS stored_rows, CASE WHEN b.part IS NULL THEN 'new' WHEN a.part IS NULL THEN 'gone' WHEN a.x = b.x AND a.y = b.y THEN 'same' ELSE 'changed' END AS state
  FROM (SELECT part, count(*) AS n, sum(x) AS x, sum(y) AS y FROM now GROUP BY 1) AS a FULL JOIN (SELECT part, count(*) AS n, sum(x) AS x, sum(y) AS y FROM past GROUP BY 1) AS b ON a.part = b.part""",
        "part, n_rows, stored_rows, state",
        "",
        """
coded AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS part, o_orderkey, md5('=' || o_orderkey || chr(31) || '=' || o_custkey || chr(31) || '=' || o_orderstatus) AS h, md5('=' || o_orderkey || chr(31) || '=' || o_custkey || chr(31) || '=X') AS hx FROM orders),
now AS (SELECT part, ('0x' || substr(h, 1, 15))::BIGINT AS x, ('0x' || substr(h, 16, 15))::BIGINT AS y FROM coded WHERE part <> 199703),
past AS (SELECT part, ('0x' || substr(g, 1, 15))::BIGINT AS x, ('0x' || substr(g, 16, 15))::BIGINT AS y FROM (SELECT part, CASE WHEN part % 5 = 1 AND o_orderkey % 50 = 0 THEN hx ELSE h END AS g FROM coded WHERE part < 200105 AND NOT (part % 7 = 2 AND o_orderkey % 90 = 1)) AS p),
""",
    ),
)
def _(spark, d):
    """The months whose orders differ between a stored state and the present one, whatever the order of rows."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("part"))
    altered = F.when((F.col("part") % 5 == 1) & (F.col("o_orderkey") % 50 == 0), "X").otherwise(F.col("o_orderstatus"))
    past = orders.filter("part < 200105 AND NOT (part % 7 = 2 AND o_orderkey % 90 = 1)").withColumn("o_orderstatus", altered).orderBy(F.desc("o_custkey"))
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    stored = written(checked.partition_digests(past, F.col("part"), columns))
    return checked.changed_partitions(checked.partition_digests(orders.filter("part <> 199703"), F.col("part"), columns), stored)

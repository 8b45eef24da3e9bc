"""Index-number queries over the price cells and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions.calendar import calendar_lag, ordinal_year, pct_change
from statloom.functions.stats import annualised
from statloom.operators import indexes, panel
from statloom.operators.ordered import shared, with_one_row, written
from statloom.plans.panel import CHANGES, WEIGHTS, changes
from statloom.plans.registry import query, show
from statloom.plans.tables import CELLS, cents, price_cells, spend_sum, table

REPS = 44
_REP_COLS = ["w0"] + [f"w{r}" for r in range(1, REPS + 1)]

# order lines of each year: unit = customer, code = brand; integer replicate weights from the key
SURVEY = f"""
buys AS (SELECT o_custkey AS unit, p_brand AS item, year(l_shipdate) AS weight_year, round(l_extendedprice * 100)::BIGINT / 100.0 AS cost
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
sw AS (SELECT c_custkey AS unit, 0 AS r, (c_custkey * 17 % 11 + 1)::DOUBLE AS wt FROM customer
  UNION ALL SELECT c_custkey, r, CASE WHEN (c_custkey * 31 + r * 7) % 5 = 0 THEN 0 ELSE ((c_custkey * (r + 3)) % 13 + 1) END FROM customer CROSS JOIN range(1, {REPS + 1}) AS t(r)),
"""
FREQ = """
fr AS (SELECT weight_year, item, r, sum(wt * n) / any_value(tot) AS freq FROM (SELECT unit, item, weight_year, count(*) AS n FROM buys GROUP BY 1, 2, 3) AS b JOIN sw USING (unit)
  JOIN (SELECT r, sum(wt) AS tot FROM sw GROUP BY 1) AS t USING (r) GROUP BY 1, 2, 3),
"""


def _survey(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.year("l_shipdate").alias("weight_year"), cents("l_extendedprice").alias("c"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("unit"))
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("item"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey).select("unit", "item", "weight_year", (F.col("c") / 100.0).alias("cost"))


def _weights(spark, d):
    cols = [F.expr("double((unit * 17) % 11 + 1) AS w0")]
    cols += [F.expr(f"if((unit * 31 + {r} * 7) % 5 = 0, 0D, double((unit * ({r} + 3)) % 13 + 1)) AS w{r}") for r in range(1, REPS + 1)]
    return table(spark, d, "customer").select(F.col("c_custkey").alias("unit")).select("unit", *cols)


def _frequencies(spark, d, columns, measures=("freq",)):
    """Purchase frequencies per (year, item): the code carries both, so one pass serves all years."""
    lines = _survey(spark, d).withColumn("code", F.concat_ws("|", F.col("weight_year").cast("string"), "item"))
    out = indexes.survey_frequencies(lines, _weights(spark, d).select("unit", *columns), columns, measures)
    parts = F.split("code", r"\|")
    return out.select(parts[0].cast("int").alias("weight_year"), parts[1].alias("item"), "weight", *measures)


def _published(cells):
    return cells.groupBy("m").agg((F.sum("spend") / F.sum("qty")).alias("level"))


PUB = "pub AS (SELECT m, sum(spend) / sum(qty) AS level FROM cells GROUP BY 1),"


def _chain_ctes(schemes: str, anchored: bool = False) -> str:
    """chain(scheme, m, coverage, rel, level, yoy) from a schemes table expression, by recursion over years."""
    base = "p.level" if anchored else "coalesce(l.lvl * r.rel / r.rel, p.level)"
    del base
    recursive = f"""
sch AS ({schemes}),
rel AS (SELECT scheme, weight_year, m, sum(w * ratio) / sum(w) AS rel, sum(w) / any_value(tot) AS coverage FROM (
   SELECT s.scheme, s.weight_year, c.m, s.w, c.idx / b.idx AS ratio, t.tot FROM sch s
   JOIN (SELECT scheme, weight_year, sum(w) AS tot FROM sch GROUP BY 1, 2 HAVING sum(w) > 0) AS t USING (scheme, weight_year)
   JOIN cells b ON b.item = s.item AND b.m = s.weight_year * 12 + 12 JOIN cells c ON c.item = s.item AND (c.m - 1) // 12 = s.weight_year + 1) AS q
   GROUP BY 1, 2, 3 HAVING sum(w) >= 0.9 * any_value(tot)),
yrs AS (SELECT DISTINCT scheme, weight_year FROM rel),
"""
    if anchored:
        return recursive + "base AS (SELECT scheme, weight_year, p.level AS base FROM yrs JOIN pub p ON p.m = weight_year * 12 + 12),"  + _LEVELS
    return (
        recursive
        + """
lk AS (SELECT y.scheme, y.weight_year, p.level AS pub, d.rel AS link FROM yrs y LEFT JOIN pub p ON p.m = y.weight_year * 12 + 12 LEFT JOIN rel d ON d.scheme = y.scheme AND d.m = y.weight_year * 12 + 12),
base AS (SELECT scheme, weight_year, first_value(pub) OVER g * product(coalesce(link, 1)) OVER g AS base FROM (
   SELECT *, sum(CASE WHEN link IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY scheme ORDER BY weight_year) AS run FROM lk) AS z
   WINDOW g AS (PARTITION BY scheme, run ORDER BY weight_year)),
"""
        + _LEVELS
    )


_LEVELS = """
lv AS (SELECT scheme, m, coverage, rel, base * rel AS level FROM rel JOIN base USING (scheme, weight_year)),
chain AS (SELECT a.*, 100 * (a.level / b.level - 1) AS yoy FROM lv a LEFT JOIN lv b ON b.scheme = a.scheme AND b.m = a.m - 12),
"""
_OFFICIAL = "SELECT 'official' AS scheme, weight_year, item, w FROM wts"
_SCHEMES = """SELECT unnest(['official', 'frequency', 'blend', 'billfloor']) AS scheme, weight_year, item,
  unnest([o, f, (o + f) / 2, b]) AS w FROM (SELECT weight_year, item, 100 * w / sum(w) OVER y AS o, 100 * fq / sum(fq) OVER y AS f,
     100 * greatest(fq, 1 / 4.345) / sum(greatest(fq, 1 / 4.345)) OVER y AS b
   FROM (SELECT w.weight_year, w.item, w.w, coalesce(f.freq, 0) AS fq FROM wts w LEFT JOIN (SELECT * FROM fr WHERE r = 0) AS f ON f.weight_year = w.weight_year AND f.item = w.item) AS j
   WINDOW y AS (PARTITION BY weight_year)) AS k"""
CH_ALL = CELLS + WEIGHTS + SURVEY + FREQ + PUB


def _cells(spark, d):
    return price_cells(spark, d)


def _official(cells):
    return panel.december_weights(cells).withColumn("scheme", F.lit("official")).select("scheme", "weight_year", "item", "w")


@query("chained_index", show("SELECT * FROM chain", "scheme, m", "coverage, rel, level, yoy", CELLS + WEIGHTS + PUB + _chain_ctes(_OFFICIAL)))
def _(spark, d):
    cells = _cells(spark, d)
    return indexes.chain(cells, _official(cells), _published(cells))


@query(
    "replica_check",
    show(
        """SELECT c.m, c.level AS ours, p.level AS published, 100 * (c.level / p.level - 1) AS diff, abs(100 * (c.level / p.level - 1)) < 3 AS ok FROM chain c JOIN pub p USING (m)
  WHERE c.m > (SELECT max(m) FROM chain) - 8""",
        "m, ok",
        "ours, published, diff",
        CELLS + WEIGHTS + PUB + _chain_ctes(_OFFICIAL, True),
    ),
)
def _(spark, d):
    cells = _cells(spark, d)
    ours = indexes.chain(cells, _official(cells), _published(cells), anchored=True).select("m", F.col("level").alias("ours"))
    last = ours.agg(F.max("m").alias("last"))
    diff = (F.col("ours") / F.col("published") - 1) * 100
    rows = ours.join(F.broadcast(last.limit(1)), F.lit(True)).filter("m > last - 8").join(_published(cells).withColumnRenamed("level", "published"), "m")
    return rows.select("m", "ours", "published", diff.alias("diff"), (F.abs(diff) < 3).alias("ok"))


@query(
    "survey_purchase_frequency",
    show(
        """SELECT weight_year, item, sum(wt * n) / any_value(tot) AS freq, sum(wt * cost) / any_value(tot) AS spend, sum(wt) / any_value(tot) AS share
  FROM (SELECT unit, item, weight_year, count(*) AS n, sum(cost) AS cost FROM buys GROUP BY 1, 2, 3) AS b JOIN (SELECT * FROM sw WHERE r = 0) AS s USING (unit)
  CROSS JOIN (SELECT sum(wt) AS tot FROM sw WHERE r = 0) AS t GROUP BY 1, 2""",
        "weight_year, item",
        "freq, spend, share",
        SURVEY,
    ),
)
def _(spark, d):
    return _frequencies(spark, d, ["w0"], ("freq", "spend", "share")).drop("weight")


def _schemes(spark, d):
    cells = _cells(spark, d)
    freq = _frequencies(spark, d, ["w0"]).select("weight_year", "item", "freq")
    return indexes.scheme_table(panel.december_weights(cells), freq)


@query("weight_schemes", show(_SCHEMES, "scheme, weight_year, item", "w", CH_ALL))
def _(spark, d):
    return _schemes(spark, d)


@query("scheme_indexes", show("SELECT * FROM chain", "scheme, m", "coverage, rel, level, yoy", CH_ALL + _chain_ctes(_SCHEMES)))
def _(spark, d):
    cells = _cells(spark, d)
    return indexes.chain(cells, written(_schemes(spark, d)), _published(cells))


@query(
    "scheme_gap_range",
    show(
        "SELECT a.m, min(a.yoy - b.yoy) AS low, max(a.yoy - b.yoy) AS high, count(*) AS variants FROM chain a JOIN chain b ON b.m = a.m AND b.scheme = 'official' WHERE a.scheme <> 'official' AND a.yoy IS NOT NULL AND b.yoy IS NOT NULL GROUP BY 1",
        "m, variants",
        "low, high",
        CH_ALL + _chain_ctes(_SCHEMES),
    ),
)
def _(spark, d):
    cells = _cells(spark, d)
    return indexes.gap_range(indexes.gap_to(indexes.chain(cells, written(_schemes(spark, d)), _published(cells))))


_REP_SCHEMES = "SELECT 'official' AS scheme, weight_year, item, w FROM wts UNION ALL SELECT 'w' || r, weight_year, item, freq FROM fr JOIN wts USING (weight_year, item)"


@query(
    "replicate_standard_error",
    show(
        f"""SELECT g.m, any_value(f.gap) AS gap, sqrt(sum(pow(g.gap - f.gap, 2)) / {REPS}) AS se, count(*) AS n_replicates FROM gaps g JOIN gaps f ON f.m = g.m AND f.scheme = 'w0' AND f.gap IS NOT NULL
  WHERE g.scheme <> 'w0' AND g.gap IS NOT NULL GROUP BY 1""",
        "m, n_replicates",
        "gap, se",
        CH_ALL + _chain_ctes(_REP_SCHEMES) + "gaps AS (SELECT a.scheme, a.m, a.yoy - b.yoy AS gap FROM chain a JOIN chain b ON b.m = a.m AND b.scheme = 'official' WHERE a.scheme <> 'official'),",
    ),
)
def _(spark, d):
    cells = _cells(spark, d)
    official = _official(cells)
    reps = _frequencies(spark, d, _REP_COLS).select(F.col("weight").alias("scheme"), "weight_year", "item", F.col("freq").alias("w"))
    reps = reps.join(official.select("weight_year", "item"), ["weight_year", "item"], "left_semi")
    schemes = written(official.unionByName(reps))
    return indexes.replicate_error(indexes.gap_to(indexes.chain(cells, schemes, _published(cells))), "w0", REPS)


@query(
    "gap_driver_table",
    show(
        """SELECT c.item, c.m, a.w * yoy / 100 AS contrib_a, b.w * yoy / 100 AS contrib_b, (a.w - b.w) * yoy / 100 AS diff FROM chg c JOIN sch a ON a.item = c.item AND a.weight_year = (c.m - 1) // 12 - 1 AND a.scheme = 'frequency'
  JOIN sch b ON b.item = c.item AND b.weight_year = a.weight_year AND b.scheme = 'official'""",
        "item, m",
        "contrib_a, contrib_b, diff",
        CH_ALL + CHANGES + f"sch AS ({_SCHEMES}),",
    ),
)
def _(spark, d):
    rows = changes(spark, d).withColumn("weight_year", ordinal_year("m") - 1)
    return indexes.gap_drivers(_schemes(spark, d), rows, "frequency", "official")


MAP = """
conc AS (SELECT DISTINCT p_name AS code, upper(split_part(p_name, ' ', 2)) || p_size AS target FROM part),
leaf AS (SELECT 'SE' || substr(upper(split_part(p_name, ' ', 2)), 1, CASE WHEN p_name LIKE '%rod' THEN 2 WHEN p_name LIKE '%widget' THEN 3 ELSE 4 END) AS item,
  CASE WHEN p_name LIKE '%bolt' THEN 0.0 ELSE sum(round(p_retailprice * 100)::BIGINT) / 100.0 END AS w FROM part WHERE p_name NOT LIKE '%anvil' GROUP BY 1, p_name LIKE '%bolt'),
am AS (SELECT code, item, sum(share) AS share FROM (SELECT code, item, CASE WHEN sum(w0) OVER c > 0 THEN w0 / sum(w0) OVER c ELSE 1.0 / count(*) OVER c END AS share FROM (
  SELECT code, target, coalesce(l4.item, l3.item, l2.item) AS item, coalesce(l4.w, l3.w, l2.w, 0) AS w0 FROM conc
   LEFT JOIN leaf l4 ON l4.item = 'SE' || substr(target, 1, 4) LEFT JOIN leaf l3 ON l3.item = 'SE' || substr(target, 1, 3) LEFT JOIN leaf l2 ON l2.item = 'SE' || substr(target, 1, 2)) AS q
  WINDOW c AS (PARTITION BY code)) AS z WHERE item IS NOT NULL GROUP BY 1, 2),
"""


def _leaf(spark, d):
    parts = table(spark, d, "part")
    word = F.upper(F.split("p_name", " ")[1])
    keep = F.when(F.col("p_name").endswith("rod"), 2).when(F.col("p_name").endswith("widget"), 3).otherwise(4)
    bolt = F.col("p_name").endswith("bolt")
    named = parts.filter(~F.col("p_name").endswith("anvil")).withColumn("item", F.concat(F.lit("SE"), F.substr(word, F.lit(1), keep))).withColumn("bolt", bolt)
    return named.groupBy("item", "bolt").agg(spend_sum("p_retailprice").alias("s")).select("item", F.when(F.col("bolt"), 0.0).otherwise(F.col("s")).alias("w"))


def _conc(spark, d):
    parts = table(spark, d, "part")
    return parts.select(F.col("p_name").alias("code"), F.concat(F.upper(F.split("p_name", " ")[1]), F.col("p_size").cast("string")).alias("target")).distinct()


@query("code_item_map", show("SELECT * FROM am", "code, item", "share", MAP))
def _(spark, d):
    return indexes.map_codes(_conc(spark, d), _leaf(spark, d))


@query(
    "class_level_spread",
    show(
        """SELECT l.item, v * CASE WHEN sum(w) OVER (PARTITION BY substr(l.item, 1, 4)) > 0 THEN w / sum(w) OVER (PARTITION BY substr(l.item, 1, 4)) ELSE 1.0 / count(*) OVER (PARTITION BY substr(l.item, 1, 4)) END AS share
  FROM leaf l JOIN (SELECT substr(item, 1, 4) AS cls, sum(share) AS v FROM am GROUP BY 1) AS s ON s.cls = substr(l.item, 1, 4)""",
        "item",
        "share",
        MAP,
    ),
)
def _(spark, d):
    leaf = _leaf(spark, d)
    return indexes.spread_in_class(indexes.map_codes(_conc(spark, d), leaf), leaf, "share").select("item", "share")


# the whole way from purchases by product name to indexes over mapped items, under each choice of the weights
_EQUAL = MAP[MAP.index("am AS") :].replace("am AS", "ame AS").replace("coalesce(l4.w, l3.w, l2.w, 0) AS w0", "(coalesce(l4.item, l3.item, l2.item) IS NOT NULL)::INT::DOUBLE AS w0")
VARIANTS = """
cells AS (SELECT item, m, sum(c) / 100.0 AS spend, sum(q) AS qty, sum(c) / 100.0 / sum(q) AS idx FROM (
  SELECT 'SE' || substr(upper(split_part(p_name, ' ', 2)), 1, CASE WHEN p_name LIKE '%rod' THEN 2 WHEN p_name LIKE '%widget' THEN 3 ELSE 4 END) AS item, year(l_shipdate) * 12 + month(l_shipdate) AS m,
   round(l_extendedprice * 100)::BIGINT AS c, l_quantity AS q FROM lineitem JOIN part ON p_partkey = l_partkey) AS z GROUP BY 1, 2),
"""
_VARIANT_FREQ = """
frc AS (SELECT weight_year, code, sum(wt * n) / any_value(tot) AS freq FROM (SELECT o_custkey AS unit, p_name AS code, year(l_shipdate) AS weight_year, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3) AS b
  JOIN (SELECT * FROM sw WHERE r = 0) AS s USING (unit) CROSS JOIN (SELECT sum(wt) AS tot FROM sw WHERE r = 0) AS t GROUP BY 1, 2),
fi AS (SELECT 'exp' AS split, weight_year, item, sum(freq * share) AS f FROM frc JOIN am USING (code) GROUP BY 1, 2, 3 UNION ALL SELECT 'equal', weight_year, item, sum(freq * share) FROM frc JOIN ame USING (code) GROUP BY 1, 2, 3),
lc AS (SELECT item, substr(item, 1, 4) AS cls, CASE WHEN sum(w) OVER c > 0 THEN w / sum(w) OVER c ELSE 1.0 / count(*) OVER c END AS s FROM leaf WINDOW c AS (PARTITION BY substr(item, 1, 4))),
fl AS (SELECT split, 'leaf' AS lvl, weight_year, item, f FROM fi UNION ALL SELECT v.split, 'class', v.weight_year, lc.item, v.f * lc.s FROM lc JOIN (SELECT split, weight_year, substr(item, 1, 4) AS cls, sum(f) AS f FROM fi GROUP BY 1, 2, 3) AS v USING (cls)),
fp AS (SELECT split, lvl, 'yearly' AS span, weight_year, item, f FROM fl UNION ALL SELECT split, lvl, 'pooled', y.weight_year, item, p.f / (SELECT count(DISTINCT weight_year) FROM frc)
  FROM (SELECT split, lvl, item, sum(f) AS f FROM fl GROUP BY 1, 2, 3) AS p CROSS JOIN (SELECT DISTINCT weight_year FROM frc) AS y),
"""
_VARIANT_SCHEMES = "SELECT 'official' AS scheme, weight_year, item, w FROM wts UNION ALL SELECT split || '/' || lvl || '/' || span, weight_year, item, 100 * f / sum(f) OVER (PARTITION BY split, lvl, span, weight_year) FROM fp"


@query(
    "sensitivity_variants",
    show(
        "SELECT a.scheme, a.m, a.yoy - b.yoy AS gap FROM chain a JOIN chain b ON b.m = a.m AND b.scheme = 'official' WHERE a.scheme <> 'official'",
        "scheme, m",
        "gap",
        VARIANTS + WEIGHTS + PUB + SURVEY + MAP + _EQUAL + _VARIANT_FREQ + _chain_ctes(_VARIANT_SCHEMES),
    ),
)
def _(spark, d):
    parts = table(spark, d, "part")
    keep = F.when(F.col("p_name").endswith("rod"), 2).when(F.col("p_name").endswith("widget"), 3).otherwise(4)
    item = F.concat(F.lit("SE"), F.substr(F.upper(F.split("p_name", " ")[1]), F.lit(1), keep))
    named = parts.select("p_partkey", F.col("p_name").alias("code"), item.alias("item"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("unit"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", cents("l_extendedprice").alias("c"), "l_quantity")
    bought = lines.join(named, lines.l_partkey == named.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey)
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    cells = bought.groupBy("item", month.alias("m")).agg((F.sum("c") / 100.0).alias("spend"), F.sum("l_quantity").alias("qty"))
    cells = written(cells.withColumn("idx", F.col("spend") / F.col("qty")))
    year = F.year("l_shipdate").cast("string")
    survey = bought.select("unit", F.concat_ws("|", year, "code").alias("code"), (F.col("c") / 100.0).alias("cost"))
    freq = indexes.survey_frequencies(survey, _weights(spark, d).select("unit", "w0"), ["w0"], ("freq",))
    split = F.split("code", r"\|", 2)
    freq = written(freq.select(split[0].cast("int").alias("weight_year"), split[1].alias("code"), "freq"))
    schemes = written(indexes.frequency_variants(freq, shared(_conc(spark, d)), shared(_leaf(spark, d))).unionByName(_official(cells)))
    return indexes.gap_to(indexes.chain(cells, schemes, _published(cells)))


TIER = """
tiers AS (SELECT item, CASE WHEN s * 20 - 6.5 >= 0.25 THEN 'high' WHEN s * 20 - 6.5 >= 0.10 THEN 'mid' ELSE 'low' END AS tier
  FROM (SELECT p_brand AS item, count(*) FILTER (WHERE l_returnflag = 'R') * 1.0 / count(*) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) AS q),
"""


def _tiers(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_returnflag")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("item"))
    share = F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1)) * 20 - 6.5
    return lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("item").agg(indexes.tier(share).alias("tier"))


@query(
    "exposure_tier_index",
    show(
        "SELECT c.scheme AS tier, m, level, yoy, tw.w AS tier_weight FROM chain c LEFT JOIN (SELECT tier, weight_year, sum(w) AS w FROM wts JOIN tiers USING (item) GROUP BY 1, 2) AS tw ON tw.tier = c.scheme AND tw.weight_year = (m - 1) // 12 - 1",
        "tier, m",
        "level, yoy, tier_weight",
        CELLS + WEIGHTS + PUB + TIER + _chain_ctes("SELECT tier AS scheme, weight_year, item, w FROM wts JOIN tiers USING (item)"),
    ),
)
def _(spark, d):
    cells = _cells(spark, d)
    schemes = _official(cells).drop("scheme").join(_tiers(spark, d), "item").withColumnRenamed("tier", "scheme")
    schemes = shared(schemes)
    sizes = schemes.groupBy(F.col("scheme").alias("tier"), "weight_year").agg(F.sum("w").alias("tier_weight"))
    chained = indexes.chain(cells, schemes, _published(cells)).withColumn("weight_year", ordinal_year("m") - 1).withColumnRenamed("scheme", "tier")
    return chained.join(sizes, ["tier", "weight_year"], "left").select("tier", "m", "level", "yoy", "tier_weight")


IO = """
flow AS (SELECT p_name AS commodity, 'N' || s_nationkey AS industry, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'F010' ELSE 'N' || c_nationkey END AS col, sr.n_regionkey <> cr.n_regionkey AND l_returnflag = 'R' AS foreign_made,
    round(l_extendedprice * 100)::BIGINT AS c, l_returnflag AS rf, p_brand AS category
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation sr ON sr.n_nationkey = s_nationkey JOIN nation cr ON cr.n_nationkey = c_nationkey),
um AS (SELECT commodity, col, sum(c) / 100.0 AS value FROM flow GROUP BY 1, 2),
mk AS (SELECT industry, commodity, sum(c) / 100.0 AS value FROM flow GROUP BY 1, 2),
im AS (SELECT commodity, col, sum(c) / 100.0 AS value FROM flow WHERE foreign_made GROUP BY 1, 2),
rq AS (SELECT DISTINCT p_name AS row, p_name AS commodity, 1.05 AS value FROM part UNION ALL SELECT DISTINCT 'hot ' || split_part(p_name, ' ', 2), p_name, 0.1 FROM part),
sdir AS (SELECT commodity, greatest(0, least(1, CASE WHEN up > 1 THEN ip / up WHEN ua > 1 THEN ia / ua ELSE 0 END)) AS direct FROM (
  SELECT commodity, sum(value) FILTER (WHERE col = 'F010') AS up, sum(value) AS ua FROM um GROUP BY 1) AS a LEFT JOIN (SELECT commodity, coalesce(sum(value) FILTER (WHERE col = 'F010'), 0) AS ip, sum(value) AS ia FROM im GROUP BY 1) AS b USING (commodity)),
mi AS (SELECT industry, coalesce(imp / nullif(x, 0), 0) AS mi FROM (SELECT industry, sum(value) AS x FROM mk GROUP BY 1) AS a LEFT JOIN (SELECT col AS industry, sum(value) AS imp FROM im WHERE col <> 'F010' GROUP BY 1) AS b USING (industry)),
mc AS (SELECT commodity, sum(mi * value) / sum(value) AS mc, sum(value) AS output FROM mk JOIN mi USING (industry) GROUP BY 1),
emb AS (SELECT rq.commodity, greatest(0, least(1, sum(mc * value))) AS embodied FROM rq JOIN mc ON mc.commodity = rq.row GROUP BY 1),
content AS (SELECT commodity, direct, embodied, greatest(0, least(1, direct + (1 - direct) * embodied)) AS total, output FROM sdir JOIN mc USING (commodity) JOIN emb USING (commodity)),
margins AS (SELECT 'transport' AS margin, (SELECT sum(embodied * output) / sum(output) FROM content WHERE commodity LIKE '%rod') AS rate, (SELECT count(*) FROM content WHERE commodity LIKE '%rod') AS n
  UNION ALL SELECT 'wholesale', (SELECT sum(embodied * output) / sum(output) FROM content WHERE commodity LIKE '%gear'), (SELECT count(*) FROM content WHERE commodity LIKE '%gear')
  UNION ALL SELECT 'retail', (SELECT avg(embodied) FROM content), 0),
bridge AS (SELECT category, commodity, sum(c) FILTER (WHERE rf = 'A') / 100.0 AS producers, coalesce(sum(c) FILTER (WHERE rf = 'N') / 200.0, 0) AS transport, coalesce(sum(c) FILTER (WHERE rf = 'N') / 400.0, 0) AS wholesale,
   coalesce(sum(c) FILTER (WHERE rf = 'N') / 400.0, 0) AS retail FROM flow GROUP BY 1, 2),
purch AS (SELECT category, purchasers, producers / purchasers AS producer_share, greatest(0, least(1, dd / purchasers)) AS share_direct,
   greatest(0, least(1, (tt + wholesale * (SELECT rate FROM margins WHERE margin = 'wholesale') + retail * (SELECT rate FROM margins WHERE margin = 'retail') + transport * (SELECT rate FROM margins WHERE margin = 'transport')) / purchasers)) AS share_total
  FROM (SELECT category, sum(producers) AS producers, sum(transport) AS transport, sum(wholesale) AS wholesale, sum(retail) AS retail, sum(coalesce(producers, 0) + transport + wholesale + retail) AS purchasers,
      CASE WHEN category = 'Brand#7' THEN sum(producers) * 0.5 ELSE sum(producers * coalesce(direct, 0)) END AS dd,
      CASE WHEN category = 'Brand#7' THEN greatest(sum(producers) * 0.5, sum(producers * coalesce(total, 0))) ELSE sum(producers * coalesce(total, 0)) END AS tt
    FROM bridge LEFT JOIN content USING (commodity) GROUP BY 1) AS z),
"""


def _flow(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", cents("l_extendedprice").alias("c"))
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("commodity"), F.col("p_brand").alias("category"))
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    makers = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.col("n_regionkey").alias("_sr"))
    buyers = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "c_mktsegment", F.col("n_regionkey").alias("_cr"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    rows = (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(makers, lines.l_suppkey == makers.s_suppkey)
        .join(orders, lines.l_orderkey == orders.o_orderkey)
    )
    return written(
        rows.groupBy(
            "commodity",
            "category",
            F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("industry"),
            F.when(F.col("c_mktsegment") == "HOUSEHOLD", "F010").otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("col"),
            ((F.col("_sr") != F.col("_cr")) & (F.col("l_returnflag") == "R")).alias("foreign"),
            F.col("l_returnflag").alias("rf"),
        ).agg(F.sum("c").alias("c"))
    )


def _content(spark, d):
    flow = _flow(spark, d)
    value = (F.sum("c") / 100.0).alias("value")
    names = table(spark, d, "part").select(F.col("p_name").alias("commodity")).distinct()
    req = names.select(F.col("commodity").alias("row"), "commodity", F.lit(1.05).alias("value")).unionByName(
        names.select(F.concat(F.lit("hot "), F.split("commodity", " ")[1]).alias("row"), "commodity", F.lit(0.1).alias("value"))
    )
    return written(
        indexes.import_content(
            flow.groupBy("commodity", "col").agg(value),
            flow.groupBy("industry", "commodity").agg(value),
            flow.filter("foreign").groupBy("commodity", "col").agg(value),
            req,
            "F010",
        )
    )


_MARGINS = {"transport": "rod$", "wholesale": "gear$", "retail": "shop$"}


@query("import_content", show("SELECT commodity, direct, embodied, total FROM content", "commodity", "direct, embodied, total", IO))
def _(spark, d):
    return _content(spark, d).drop("output")


@query("margin_embodied_rates", show("SELECT * FROM margins", "margin, n", "rate", IO))
def _(spark, d):
    return indexes.margin_rate(_content(spark, d), _MARGINS)


def _purchasers(spark, d):
    flow = _flow(spark, d)
    content = _content(spark, d)
    n = F.coalesce(F.sum(F.when(F.col("rf") == "N", F.col("c"))), F.lit(0))
    bridge = flow.groupBy("category", "commodity").agg(
        (F.sum(F.when(F.col("rf") == "A", F.col("c"))) / 100.0).alias("producers"), (n / 200.0).alias("transport"), (n / 400.0).alias("wholesale"), (n / 400.0).alias("retail")
    )
    bridge = bridge.withColumn("purchasers", F.coalesce("producers", F.lit(0.0)) + F.col("transport") + F.col("wholesale") + F.col("retail"))
    overrides = spark.createDataFrame([("Brand#7", 0.5)], "category string, rate double")
    return indexes.bridge_to_purchasers(bridge, content, indexes.margin_rate(content, _MARGINS), overrides)


@query("purchaser_bridge", show("SELECT * FROM purch", "category", "producer_share, share_direct, share_total", IO, "purchasers"))
def _(spark, d):
    return _purchasers(spark, d).withColumn("purchasers", F.round("purchasers", 2))


@query(
    "concordance_item_shares",
    show(
        """SELECT item, sum(share * share_total) / sum(share) AS share_total, count(*) AS n FROM (SELECT DISTINCT p_name AS item, p_brand AS category, 1.0 + length(p_brand) AS share FROM part) AS m
  JOIN purch USING (category) WHERE category <> 'Brand#3' GROUP BY 1""",
        "item",
        "share_total",
        IO,
    ),
)
def _(spark, d):
    parts = table(spark, d, "part").select(F.col("p_name").alias("item"), F.col("p_brand").alias("category")).distinct()
    mapping = parts.withColumn("description", F.col("category")).withColumn("share", F.lit(1.0) + F.length("category"))
    shares = _purchasers(spark, d).select("category", F.when(F.col("category") == "Brand#3", "renamed").otherwise(F.upper("category")).alias("description"), "share_total")
    return indexes.concordance_mean(mapping, shares)[0]


@query(
    "concordance_drift_rows",
    show("SELECT DISTINCT p_name AS item, p_brand AS category, 'drift' AS problem FROM part WHERE p_brand = 'Brand#3'", "item, category, problem"),
)
def _(spark, d):
    parts = table(spark, d, "part").select(F.col("p_name").alias("item"), F.col("p_brand").alias("category")).distinct()
    mapping = parts.withColumn("description", F.col("category")).withColumn("share", F.lit(1.0))
    shares = parts.select("category").distinct().select("category", F.when(F.col("category") == "Brand#3", "renamed").otherwise(F.upper("category")).alias("description"), F.lit(0.5).alias("share_total"))
    return indexes.concordance_mean(mapping, shares)[1]


@query(
    "haircut_item_shares",
    show(
        """SELECT item, base * h * 0.7 AS share_direct, base * h AS share_total FROM (SELECT item, CASE substr(item, 1, 3) WHEN 'hot' THEN 0.6 WHEN 'red' THEN 0.5 ELSE 0.4 END AS h,
  CASE WHEN substr(item, 1, 3) IN ('hot', 'red', 'old') THEN (SELECT avg(total) FROM content WHERE total > 0) ELSE 0 END AS base FROM (SELECT DISTINCT p_name AS item FROM part)) AS q""",
        "item",
        "share_direct, share_total",
        IO,
    ),
)
def _(spark, d):
    items = table(spark, d, "part").select(F.col("p_name").alias("item")).distinct()
    return indexes.haircut_shares(items, _content(spark, d), [("hot", 0.6), ("red", 0.5)], ["hot", "red", "old"], 0.4)


@query(
    "import_share_checks",
    show(
        """SELECT c.*, coalesce(ours BETWEEN expected_low AND expected_high, false) AS ok FROM (
  SELECT unnest(['by purchase value', 'goods of the basket', 'whole basket']) AS "check", unnest([p, g, b]) AS ours, unnest([0.05, b, 0.0]) AS expected_low, unnest([0.6, 1.0, 1.0]) AS expected_high FROM (
   SELECT sum(CASE WHEN purchasers > 0 THEN purchasers * share_total END) / sum(CASE WHEN purchasers > 0 THEN purchasers END) AS p, sum(coalesce(w, 0) * coalesce(share_total, 0)) / sum(coalesce(w, 0)) AS b,
    sum(CASE WHEN producer_share < 0.98 THEN coalesce(w, 0) * coalesce(share_total, 0) END) / nullif(sum(CASE WHEN producer_share < 0.98 THEN coalesce(w, 0) END), 0) AS g
   FROM (SELECT p_brand AS category, sum(l_quantity) AS w FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) AS k FULL JOIN purch USING (category)) AS m) AS c""",
        '"check", ok',
        "ours, expected_low, expected_high",
        IO,
    ),
)
def _(spark, d):
    """Import shares by purchase value, over the basket and over its goods."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("item"))
    basket = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("item").agg(F.sum("l_quantity").alias("w"))
    return indexes.import_share_checks(basket, _purchasers(spark, d).withColumnRenamed("category", "item"), 0.05, 0.6)


@query(
    "economy_import_share",
    show(
        """SELECT year, num / den AS share, abs(num / den - 0.27) <= 0.01 AS ok FROM (SELECT year(l_shipdate) AS year, sum(CASE WHEN sr.n_regionkey <> cr.n_regionkey AND l_returnflag = 'R' THEN round(l_extendedprice * 100)::BIGINT ELSE 0 END) AS num, sum(round(l_extendedprice * 100)::BIGINT) AS den
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation sr ON sr.n_nationkey = s_nationkey JOIN nation cr ON cr.n_nationkey = c_nationkey WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY 1) AS t""",
        "year, ok",
        "share",
    ),
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", F.year("l_shipdate").alias("year"), cents("l_extendedprice").alias("c"))
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    makers = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("_sr"))
    buyers = table(spark, d, "customer").filter("c_mktsegment = 'HOUSEHOLD'").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("_cr"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    rows = lines.join(makers, lines.l_suppkey == makers.s_suppkey).join(orders, lines.l_orderkey == orders.o_orderkey)
    foreign = (F.col("_sr") != F.col("_cr")) & (F.col("l_returnflag") == "R")
    out = rows.groupBy("year").agg((F.sum(F.when(foreign, F.col("c")).otherwise(0)) / F.sum("c")).alias("share"))
    return out.withColumn("ok", F.abs(F.col("share") - 0.27) <= 0.01)


GAP = """
two AS (SELECT item, m, a, b FROM (SELECT p_brand AS item, year(l_shipdate) * 12 + month(l_shipdate) AS m,
   sum(round(l_extendedprice * 100)::BIGINT) / 100.0 / sum(l_quantity) AS a, sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT) / 100.0 / sum(l_quantity) AS b
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) AS q),
gap AS (SELECT t.item, t.m, 100 * (t.a / l.a - 1) AS yoy_a, 100 * (t.b / l.b - 1) AS yoy_b, 100 * (t.a / l.a - 1) - 100 * (t.b / l.b - 1) AS gap_yoy,
  100 * t.a / z.a AS rel_a, 100 * t.b / z.b AS rel_b, 100 * ((t.a / z.a) / (t.b / z.b) - 1) AS gap_cum
  FROM two t LEFT JOIN two l ON l.item = t.item AND l.m = t.m - 12 LEFT JOIN two z ON z.item = t.item AND z.m = 23952),
"""


def _two(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("item"))
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint")
    m = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("item", m.alias("m")).agg(
        (spend_sum("l_extendedprice") / F.sum("l_quantity")).alias("a"), (F.sum(net) / 100.0 / F.sum("l_quantity")).alias("b")
    )
    return shared(rows)


def _gap(spark, d):
    two = _two(spark, d)
    return indexes.formula_gap(two.withColumnRenamed("a", "idx"), two.withColumnRenamed("b", "idx"), 1995 * 12 + 12)


@query("formula_gap", show("SELECT * FROM gap", "item, m", "yoy_a, yoy_b, gap_yoy, rel_a, rel_b, gap_cum", CELLS + GAP))
def _(spark, d):
    return _gap(spark, d)


@query(
    "gap_decomposition",
    show(
        """SELECT m, component_gap, weight_covered, total_gap, total_gap - component_gap AS residual FROM (SELECT g.m, sum(w * gap_yoy) / sum(w) AS component_gap, sum(w) AS weight_covered FROM gap g JOIN wts ON wts.item = g.item AND wts.weight_year = (SELECT max(weight_year) FROM wts)
  WHERE gap_yoy IS NOT NULL AND g.item <> 'Brand#1' GROUP BY 1) AS c JOIN (SELECT m, gap_yoy AS total_gap FROM gap WHERE item = 'Brand#1') AS t USING (m)""",
        "m",
        "component_gap, weight_covered, total_gap, residual",
        CELLS + WEIGHTS + GAP,
    ),
)
def _(spark, d):
    gap = shared(_gap(spark, d))
    weights = panel.latest_weights(price_cells(spark, d))
    parts = gap.filter("item <> 'Brand#1'").join(weights, "item").select("m", "w", F.col("gap_yoy").alias("gap"))
    return indexes.gap_decomposition(parts, gap.filter("item = 'Brand#1'").select("m", F.col("gap_yoy").alias("gap")))


@query(
    "gap_rankings_heatmap",
    show(
        """SELECT g.item, g.m, gap_cum, place FROM gap g JOIN (SELECT item, rank() OVER (ORDER BY round(gap_cum, 9) DESC) AS place FROM gap WHERE m = (SELECT max(m) FROM gap) AND gap_cum IS NOT NULL) AS r USING (item)
  WHERE g.m > (SELECT max(m) FROM gap) - 120""",
        "item, m, place",
        "gap_cum",
        CELLS + GAP,
    ),
)
def _(spark, d):
    return indexes.gap_heatmap(shared(_gap(spark, d)))


@query(
    "long_run_rates",
    show(
        "SELECT item, 100 * (pow(rel_a / 100, 12.0 / (m - 23952)) - 1) AS rate_a, 100 * (pow(rel_b / 100, 12.0 / (m - 23952)) - 1) AS rate_b FROM gap WHERE m = (SELECT max(m) FROM gap)",
        "item",
        "rate_a, rate_b",
        CELLS + GAP,
    ),
)
def _(spark, d):
    gap = _gap(spark, d)
    rows = with_one_row(gap, gap.agg(F.max("m").alias("last"))).filter("m = last")
    months = F.col("m") - 23952
    return rows.select("item", annualised(F.col("rel_a"), F.lit(100.0), months).alias("rate_a"), annualised(F.col("rel_b"), F.lit(100.0), months).alias("rate_b"))


TREE = """
tree0 AS (SELECT DISTINCT p_type AS scope, p_name AS item, 2 AS level, split_part(p_name, ' ', 2) || '/' || p_name AS sort FROM part
  UNION SELECT DISTINCT p_type, split_part(p_name, ' ', 2), 1, split_part(p_name, ' ', 2) FROM part WHERE p_name NOT LIKE '%rod'
  UNION SELECT DISTINCT p_type, 'ALL', 0, '' FROM part),
ptree AS (SELECT t.scope, t.item, t.level, t.sort, CASE level WHEN 2 THEN (CASE WHEN item LIKE '%rod' THEN NULL ELSE split_part(item, ' ', 2) END) WHEN 1 THEN 'ALL' END AS parent FROM tree0 t),
"""


def _tree(spark, d):
    parts = table(spark, d, "part").select("p_type", "p_name", "p_size")
    word = F.split("p_name", " ")[1]
    leaf = parts.select(F.col("p_type").alias("scope"), F.col("p_name").alias("item"), F.lit(2).alias("level"), F.concat(word, F.lit("/"), "p_name").alias("sort"))
    mid = parts.filter(~F.col("p_name").endswith("rod")).select(F.col("p_type").alias("scope"), word.alias("item"), F.lit(1).alias("level"), word.alias("sort"))
    top = parts.select(F.col("p_type").alias("scope"), F.lit("ALL").alias("item"), F.lit(0).alias("level"), F.lit("").alias("sort"))
    return leaf.unionByName(mid).unionByName(top).distinct()


@query(
    "parents_from_display_level",
    show(
        """SELECT scope, item, level, CASE WHEN level = 2 THEN (SELECT CASE WHEN max_by_level = 1 THEN cand END FROM (SELECT arg_max(t2.item, t2.sort) AS cand, arg_max(t2.level, t2.sort) AS max_by_level FROM tree0 t2 WHERE t2.scope = a.scope AND t2.sort < a.sort AND t2.level < 2))
  WHEN level = 1 THEN 'ALL' END AS parent FROM tree0 a""",
        "scope, item, level, parent",
        "",
        TREE,
    ),
)
def _(spark, d):
    return panel.parents_from_levels(_tree(spark, d), "scope", "item", "sort", "level").select("scope", "item", "level", "parent")


# a group's published weight counts large parts a fifth higher, so its members do not always carry all of it
TREE1 = """
priced AS (SELECT p_name AS item, split_part(p_name, ' ', 2) AS word, round(p_retailprice * 100)::BIGINT AS c, CASE WHEN p_size >= 47 THEN round(p_retailprice * 100)::BIGINT // 5 ELSE 0 END AS extra FROM part),
nodes AS (SELECT item, word AS parent, sum(c) / 100.0 AS w FROM priced GROUP BY 1, 2
  UNION ALL SELECT word, 'ALL', sum(c + extra) / 100.0 FROM priced GROUP BY 1 UNION ALL SELECT 'ALL', NULL, sum(c + extra) / 100.0 FROM priced),
"""


def _nodes(spark, d):
    parts = table(spark, d, "part").select(F.col("p_name").alias("item"), F.split("p_name", " ")[1].alias("word"), cents("p_retailprice").alias("c"), "p_size")
    parts = parts.withColumn("published", F.col("c") + F.when(F.col("p_size") >= 47, F.floor(F.col("c") / 5)).otherwise(0))
    leaf = parts.groupBy("item", F.col("word").alias("parent")).agg((F.sum("c") / 100.0).alias("w"))
    mid = parts.groupBy(F.col("word").alias("item")).agg((F.sum("published") / 100.0).alias("w")).withColumn("parent", F.lit("ALL"))
    top = parts.agg((F.sum("published") / 100.0).alias("w")).withColumn("item", F.lit("ALL")).withColumn("parent", F.lit(None).cast("string"))
    return shared(leaf.unionByName(mid).unionByName(top))


@query("tree_leaves", show("SELECT item, parent FROM nodes WHERE item NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)", "item, parent", "", TREE1))
def _(spark, d):
    return panel.leaves(_nodes(spark, d)).select("item", "parent")


@query(
    "tree_ancestor_closure",
    show(
        "SELECT item, parent AS ancestor, 1 AS depth FROM nodes WHERE parent IS NOT NULL UNION ALL SELECT a.item, b.parent, 2 FROM nodes a JOIN nodes b ON b.item = a.parent WHERE b.parent IS NOT NULL",
        "item, ancestor, depth",
        "",
        TREE1,
    ),
)
def _(spark, d):
    return panel.ancestors(_nodes(spark, d).select("item", "parent"))


@query(
    "complete_partition",
    show(
        """SELECT n.item, n.parent, n.w FROM nodes n LEFT JOIN (SELECT parent AS item, sum(w) AS cw FROM nodes GROUP BY 1) AS c USING (item)
  LEFT JOIN (SELECT p.item, coalesce(k.cw >= 0.99 * p.w, false) AS popen FROM nodes p LEFT JOIN (SELECT parent AS item, sum(w) AS cw FROM nodes GROUP BY 1) AS k USING (item)) AS po ON po.item = n.parent
  WHERE NOT coalesce(c.cw >= 0.99 * n.w, false) AND coalesce(po.popen, true)""",
        "item, parent",
        "w",
        TREE1,
    ),
)
def _(spark, d):
    nodes = _nodes(spark, d)
    return panel.complete_partition(nodes.select("item", "parent"), nodes.select("item", "w"))


@query(
    "group_assignment",
    show(
        "SELECT item, parent, CASE WHEN item IN ('gear', 'ring', 'ALL') THEN item WHEN parent IN ('gear', 'ring', 'ALL') THEN parent WHEN parent IS NOT NULL THEN 'ALL' END AS grp FROM nodes",
        "item, parent, grp",
        "",
        TREE1,
    ),
)
def _(spark, d):
    nodes = _nodes(spark, d).select("item", "parent")
    return panel.nearest_ancestor(nodes, nodes.filter(F.col("item").isin("gear", "ring", "ALL")))


@query(
    "positive_monthly_change",
    show(
        """SELECT c.item, c.m, CASE WHEN a.idx > 0 THEN 100 * (c.idx / a.idx - 1) END AS mom, CASE WHEN b.idx > 0 THEN 100 * (c.idx / b.idx - 1) END AS yoy FROM cells c LEFT JOIN cells a ON a.item = c.item AND a.m = c.m - 1
  LEFT JOIN cells b ON b.item = c.item AND b.m = c.m - 12 WHERE c.m > (SELECT max(m) FROM cells) - 36""",
        "item, m",
        "mom, yoy",
        CELLS,
    ),
)
def _(spark, d):
    cells = price_cells(spark, d)
    rows = panel.positive_change(panel.positive_change(cells, "item", "m", "idx", 1, "mom"), "item", "m", "idx", 12, "yoy")
    last = cells.agg(F.max("m").alias("last"))
    return rows.join(F.broadcast(last.limit(1)), F.lit(True)).filter("m > last - 36").select("item", "m", "mom", "yoy")


@query(
    "calendar_grid_last_value",
    show(
        """SELECT g.item, g.m, v.price FROM (SELECT item, unnest(range(lo, hi + 1)) AS m FROM (SELECT p_name || '/' || p_brand AS item, min(year(l_shipdate) * 12 + month(l_shipdate)) AS lo, max(year(l_shipdate) * 12 + month(l_shipdate)) AS hi FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)) AS g
  LEFT JOIN (SELECT p_name || '/' || p_brand AS item, year(l_shipdate) * 12 + month(l_shipdate) AS m, arg_max(l_extendedprice, l_orderkey * 1000 + l_linenumber * 100 + l_quantity) AS price FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) AS v USING (item, m)""",
        "item, m",
        "price",
    ),
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).alias("seq"))
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_name", "p_brand").alias("item"))
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select("item", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("m"), F.col("l_extendedprice").alias("price"), "seq")
    return panel.complete_calendar(rows, "item", "m", "price")

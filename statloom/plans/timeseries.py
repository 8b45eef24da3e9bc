"""Persistence, pass-through, event-study and network queries over brand price changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions.calendar import calendar_lag, ordinal_month, ordinal_year, pct_change
from statloom.functions.stats import pair_corr
from statloom.operators import network, panel, regress, timeseries, xsection
from statloom.operators.ordered import shared, with_one_row, written
from statloom.plans.indexes import TIER, _published, _tiers
from statloom.plans.panel import CHANGES, WEIGHTED, WEIGHTS, changes, weighted_changes
from statloom.plans.registry import query, show
from statloom.plans.tables import CELLS, cents, price_cells, table

W, MIN = 24, 18

RATES = """
hd AS (SELECT m, 0 AS z, sum(spend) / sum(qty) AS idx FROM cells GROUP BY 1),
hc AS (SELECT a.m, 100 * (a.idx / b.idx - 1) AS hsa, 100 * (ln(a.idx) - ln(c.idx)) / 12 AS h12 FROM hd a LEFT JOIN hd b ON b.m = a.m - 1 LEFT JOIN hd c ON c.m = a.m - 12),
src AS (SELECT c.item, c.m, mom, (ln(c.idx) - ln(p.idx)) / 12 * 100 AS n12 FROM chg c LEFT JOIN cells p ON p.item = c.item AND p.m = c.m - 12),
rates AS (SELECT s.item, s.m, k.source, CASE WHEN k.source = 'sa' THEN mom ELSE n12 END AS raw, CASE WHEN k.source = 'sa' THEN mom - hsa ELSE n12 - h12 END AS rel
  FROM src s JOIN (SELECT item, CASE WHEN count(mom) >= 60 AND item NOT IN ('Brand#2') THEN 'sa' WHEN count(n12) >= 60 THEN 'nsa12' END AS source FROM src GROUP BY 1) AS k USING (item) JOIN hc USING (m) WHERE k.source IS NOT NULL),
"""


def _panel(spark, d):
    rows = changes(spark, d)
    # one brand publishes no adjusted rate, so both sources occur
    return rows.select("item", "m", F.when(F.col("item") != "Brand#2", F.col("mom")).alias("mom_sa"), F.col("idx").alias("idx_nsa"))


def rates(spark, d):
    """Rates are read by every persistence query."""
    head = _published(price_cells(spark, d)).withColumn("_z", F.lit(0))
    head = head.select("m", pct_change("level", calendar_lag("level", "_z", "m", 1)).alias("mom_sa"), F.col("level").alias("idx_nsa"))
    return written(timeseries.rate_source(_panel(spark, d), head, min_obs=60))


@query("rate_source_choice", show("SELECT * FROM rates", "item, m, source", "raw, rel", CELLS + CHANGES + RATES))
def _(spark, d):
    return rates(spark, d)


_LP = ", ".join(
    f"CASE WHEN count(CASE WHEN x IS NOT NULL AND l{h} IS NOT NULL THEN 1 END) OVER w{h} >= {MIN - h} THEN regr_slope(x, l{h}) OVER w{h} END AS lp{h}" for h in (1, 3, 6, 12)
)
_WIN = ", ".join(f"w{h} AS (PARTITION BY universe, item ORDER BY m RANGE BETWEEN {W - 1 - h} PRECEDING AND CURRENT ROW)" for h in (1, 3, 6, 12))
PERSIST = f"""
uni AS (SELECT item, m, 'raw' AS universe, raw AS x FROM rates UNION ALL SELECT item, m, 'rel', rel FROM rates),
gr AS (SELECT universe, item, unnest(range(min(m), max(m) + 1)) AS m FROM uni GROUP BY 1, 2),
dl AS (SELECT g.universe, g.item, g.m, u.x, {', '.join(f'x{h}.x AS l{h}' for h in (1, 3, 6, 12))} FROM gr g LEFT JOIN uni u ON u.universe = g.universe AND u.item = g.item AND u.m = g.m
  {' '.join(f'LEFT JOIN uni x{h} ON x{h}.universe = g.universe AND x{h}.item = g.item AND x{h}.m = g.m - {h}' for h in (1, 3, 6, 12))}),
pers AS (SELECT universe, item, m, n_obs, rho, CASE WHEN rho <= 0 THEN 0 WHEN rho >= 1 THEN 60 ELSE least(60, ln(0.5) / ln(rho)) END AS halflife, lp1, lp3, lp6, lp12 FROM (
  SELECT universe, item, m, count(CASE WHEN x IS NOT NULL AND l1 IS NOT NULL THEN 1 END) OVER w1 AS n_obs, regr_slope(x, l1) OVER w1 AS rho, {_LP}, m - min(m) OVER (PARTITION BY universe, item) AS age FROM dl WINDOW {_WIN}) AS q
  WHERE n_obs >= {MIN} AND age >= {W - 1}),
"""
P_ALL = CELLS + CHANGES + RATES + PERSIST


def persist(spark, d):
    long = rates(spark, d).select("item", "m", "raw", "rel").unpivot(["item", "m"], ["raw", "rel"], "universe", "x")
    return written(timeseries.persistence(long, ["universe", "item"], "x", W, MIN))


@query("rolling_persistence", show("SELECT * FROM pers", "universe, item, m, n_obs", "rho, halflife, lp1, lp3, lp6, lp12", P_ALL))
def _(spark, d):
    return persist(spark, d)


# a window may end in a month without a value of its own
ENDS = f"""
egrid AS (SELECT item, lo, unnest(range(lo, hi + 1)) AS m FROM (SELECT item, min(m) AS lo, max(m) AS hi FROM chg WHERE mom IS NOT NULL GROUP BY 1) AS g),
epair AS (SELECT g.item, g.m, g.lo, CASE WHEN a.mom IS NOT NULL AND b.mom IS NOT NULL THEN 1 ELSE 0 END AS k FROM egrid g LEFT JOIN chg a ON a.item = g.item AND a.m = g.m LEFT JOIN chg b ON b.item = g.item AND b.m = g.m - 1),
ends AS (SELECT item, m FROM (SELECT item, m, lo, sum(k) OVER (PARTITION BY item ORDER BY m RANGE BETWEEN {W - 2} PRECEDING AND CURRENT ROW) AS k FROM epair) AS e WHERE m - lo >= {W - 1} AND k >= {MIN}),
"""


@query(
    "projection_newey_west_error",
    show(
        """SELECT item, m, CASE WHEN s > 0 THEN sqrt(s * n / (n - 2)) / sxx END AS lp_se FROM (
  SELECT a.item, a.m, a.n, a.sxx, sum(z.zz) + 2 * coalesce((SELECT sum((1 - (b.s - c.s) / 5.0) * b.z * c.z) FROM zs b JOIN zs c ON c.item = b.item AND c.m = b.m AND b.s - c.s BETWEEN 1 AND 4 WHERE b.item = a.item AND b.m = a.m), 0) AS s
  FROM fits a JOIN (SELECT item, m, z * z AS zz FROM zs) AS z ON z.item = a.item AND z.m = a.m GROUP BY a.item, a.m, a.n, a.sxx) AS q WHERE s > 0""",
        "item, m",
        "lp_se",
        CELLS
        + CHANGES
        + ENDS
        + f"""
ex AS (SELECT e.item, e.m, x.m AS s, x.mom AS x, y.mom AS y FROM ends e JOIN chg x ON x.item = e.item AND x.m BETWEEN e.m - {W - 1} AND e.m - 3 JOIN chg y ON y.item = x.item AND y.m = x.m + 3 WHERE x.mom IS NOT NULL AND y.mom IS NOT NULL),
fits AS (SELECT item, m, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, var_pop(x) * count(*) AS sxx FROM ex GROUP BY 1, 2 HAVING count(*) >= {MIN - 3}),
zs AS (SELECT ex.item, ex.m, s, (x - mx) * (y - my - b * (x - mx)) AS z FROM ex JOIN fits USING (item, m)),""",
    ),
)
def _(spark, d):
    rows = changes(spark, d).filter("mom IS NOT NULL")
    return timeseries.rolling_ar3_and_errors(rows, "item", "mom", W, MIN, 3).select("item", "m", "lp_se").filter("lp_se IS NOT NULL")


CLASSED = P_ALL + WEIGHTS + """
dec AS (SELECT p.item, p.rho, p.halflife, r.source, w.w FROM pers p JOIN (SELECT DISTINCT item, source FROM rates) AS r USING (item) JOIN wts w ON w.item = p.item AND w.weight_year = (SELECT max(weight_year) FROM wts) WHERE universe = 'raw' AND m = (SELECT max(m) FROM pers WHERE universe = 'raw' AND rho IS NOT NULL) AND rho IS NOT NULL),
"""


def classed(spark, d):
    weights = panel.latest_weights(price_cells(spark, d)).select("item", "w")
    sources = rates(spark, d).select("item", "source").distinct()
    known = persist(spark, d).filter("universe = 'raw' AND rho IS NOT NULL")
    at = with_one_row(known, known.agg(F.max("m").alias("last"))).filter("m = last").select("item", "rho", "halflife")
    return shared(at.join(sources, "item").join(weights, "item"))


@query(
    "sticky_flexible_scores",
    show(
        """SELECT item, source, rho, w, (rk - 0.5) / n AS score, CASE WHEN rho >= med THEN 1 ELSE 0 END AS binary_flag, greatest(0, least(0.99, rho)) AS pooled FROM (
  SELECT d.*, rank() OVER (PARTITION BY source ORDER BY rho) + (count(*) OVER (PARTITION BY source, rho) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY source) AS n,
   (SELECT min(rho) FROM (SELECT rho, sum(w) OVER (ORDER BY rho) / sum(w) OVER () AS u FROM dec e WHERE e.source = d.source) AS c WHERE u >= 0.5) AS med FROM dec d) AS q""",
        "item, source, binary_flag",
        "rho, w, score, pooled",
        CLASSED,
    ),
)
def _(spark, d):
    rows = classed(spark, d)
    med = xsection.weighted_median(rows, "source", "rho", "w", "med")
    scored = xsection.rank_percentile(rows, "source", "rho", "score").join(med, "source")
    return scored.select(
        "item", "source", "rho", "w", "score", F.when(F.col("rho") >= F.col("med"), 1).otherwise(0).alias("binary_flag"), F.greatest(F.lit(0.0), F.least(F.lit(0.99), "rho")).alias("pooled")
    )


@query(
    "half_life_weight_buckets",
    show(
        """SELECT coalesce(source, 'all') AS source, 100 * sum(CASE WHEN halflife < 3 THEN w ELSE 0 END) / sum(w) AS under3, 100 * sum(CASE WHEN halflife >= 3 AND halflife <= 12 THEN w ELSE 0 END) / sum(w) AS mid,
  100 * sum(CASE WHEN halflife > 12 AND halflife < 60 THEN w ELSE 0 END) / sum(w) AS over12, 100 * sum(CASE WHEN halflife >= 60 THEN w ELSE 0 END) / sum(w) AS capped FROM dec GROUP BY ROLLUP (source)""",
        "source",
        "under3, mid, over12, capped",
        CLASSED,
    ),
)
def _(spark, d):
    h = F.col("halflife")
    share = lambda c: (F.sum(F.when(c, F.col("w")).otherwise(0.0)) * 100 / F.sum("w"))
    out = classed(spark, d).rollup("source").agg(share(h < 3).alias("under3"), share((h >= 3) & (h <= 12)).alias("mid"), share((h > 12) & (h < 60)).alias("over12"), share(h >= 60).alias("capped"))
    return out.withColumn("source", F.coalesce("source", F.lit("all")))


@query(
    "expanding_percentile",
    show(
        """SELECT a.item, a.m, a.rho, CASE WHEN count(b.rho) >= 12 THEN 100.0 * count(CASE WHEN b.rho <= a.rho THEN 1 END) / count(b.rho) END AS hist_pct FROM pers a JOIN pers b ON b.universe = a.universe AND b.item = a.item AND b.m <= a.m WHERE a.universe = 'rel' GROUP BY 1, 2, 3""",
        "item, m",
        "rho, hist_pct",
        P_ALL,
    ),
)
def _(spark, d):
    rows = persist(spark, d).filter("universe = 'rel'").select("item", "m", "rho")
    return xsection.expanding_percentile(rows, "item", "m", "rho")


@query(
    "spearman_by_month",
    show(
        """SELECT m, n, CASE WHEN n >= 5 THEN r END AS rho FROM (SELECT m, count(*) AS n, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS r FROM (SELECT m, rank() OVER (PARTITION BY m ORDER BY a) + (count(*) OVER (PARTITION BY m, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY m ORDER BY b) + (count(*) OVER (PARTITION BY m, b) - 1) / 2.0 AS rb FROM (SELECT p.m, p.halflife AS a, q.halflife AS b FROM pers p JOIN pers q ON q.item = p.item AND q.m = p.m AND q.universe = 'rel' WHERE p.universe = 'raw' AND p.halflife IS NOT NULL AND q.halflife IS NOT NULL) AS z) AS y GROUP BY 1) AS x""",
        "m, n",
        "rho",
        P_ALL,
    ),
)
def _(spark, d):
    rows = persist(spark, d).groupBy("item", "m").pivot("universe", ["raw", "rel"]).agg(F.max("halflife"))
    return xsection.spearman(rows, "m", "raw", "rel")


@query(
    "coverage_gate",
    show(
        """SELECT p.item, p.m, p.rho FROM pers p JOIN wts w ON w.item = p.item AND w.weight_year = (SELECT max(weight_year) FROM wts) WHERE universe = 'raw' AND m IN (SELECT m FROM pers x JOIN wts y ON y.item = x.item AND y.weight_year = (SELECT max(weight_year) FROM wts) WHERE universe = 'raw' GROUP BY 1
  HAVING sum(CASE WHEN rho IS NOT NULL THEN w ELSE 0 END) >= 0.9 * sum(w))""",
        "item, m",
        "rho",
        P_ALL + WEIGHTS,
    ),
)
def _(spark, d):
    weights = panel.latest_weights(price_cells(spark, d)).select("item", "w")
    rows = persist(spark, d).filter("universe = 'raw'").join(weights, "item")
    return xsection.coverage_gate(rows, "m", F.col("rho").isNotNull(), "w").select("item", "m", "rho")


@query(
    "persistence_latest_cross_section",
    show(
        """SELECT p.item, max(CASE WHEN universe = 'raw' THEN rho END) AS rho_raw, max(CASE WHEN universe = 'rel' THEN rho END) AS rho_rel, any_value(w.w) AS w, any_value(c.yoy) AS yoy FROM pers p
  JOIN wts w ON w.item = p.item AND w.weight_year = (SELECT max(weight_year) FROM wts) JOIN chg c ON c.item = p.item AND c.m = p.m WHERE p.m = (SELECT max(m) FROM pers) GROUP BY 1""",
        "item",
        "rho_raw, rho_rel, w, yoy",
        P_ALL + WEIGHTS,
    ),
)
def _(spark, d):
    rows = persist(spark, d)
    last = with_one_row(rows, rows.agg(F.max("m").alias("last"))).filter("m = last")
    wide = last.groupBy("item", "m").pivot("universe", ["raw", "rel"]).agg(F.max("rho"))
    weights = panel.latest_weights(price_cells(spark, d)).select("item", "w")
    return wide.join(weights, "item").join(changes(spark, d).select("item", "m", "yoy"), ["item", "m"]).select("item", F.col("raw").alias("rho_raw"), F.col("rel").alias("rho_rel"), "w", "yoy")


@query(
    "deseasonalised_changes",
    show("SELECT item, m, mom - avg(mom) OVER (PARTITION BY item, (m - 1) % 12) AS mom FROM chg WHERE mom IS NOT NULL", "item, m", "mom", CELLS + CHANGES),
)
def _(spark, d):
    return timeseries.deseasonalise(changes(spark, d).filter("mom IS NOT NULL").select("item", "m", "mom"), "item", "mom")


# every brand with the next one in text order as its destination
PAIRS = """
brands AS (SELECT item, lead(item) OVER (ORDER BY item) AS nxt, row_number() OVER (ORDER BY item) AS rn FROM (SELECT DISTINCT item FROM cells) AS b),
pairs AS (SELECT item || '>' || nxt AS pair, item AS src, nxt AS dst FROM brands WHERE nxt IS NOT NULL),
ser AS (SELECT item AS series, m, mom AS v FROM chg WHERE mom IS NOT NULL),
"""
PROFILE = """
prof AS (SELECT pair, lag, n, CASE WHEN n >= 36 THEN r END AS rho FROM (SELECT p.pair, k.lag, count(*) AS n, corr(x.v, y.v) AS r FROM pairs p CROSS JOIN range(-3, 19) AS k(lag)
   JOIN ser x ON x.series = p.src JOIN ser y ON y.series = p.dst AND y.m = x.m + k.lag GROUP BY 1, 2) AS q),
best AS (SELECT pair, arg_max(lag, round(rho, 12) * 1000 - lag * 1e-9) FILTER (WHERE lag >= 0 AND rho IS NOT NULL) AS best_lag, max(rho) FILTER (WHERE lag >= 0) AS rho_best, max(rho) FILTER (WHERE lag < 0) AS lead_max, max(rho) FILTER (WHERE lag = 0) AS rho0 FROM prof GROUP BY 1 HAVING count(*) FILTER (WHERE lag >= 0 AND rho IS NOT NULL) > 0),
"""


def series_pairs(spark, d):
    from pyspark.sql import Window

    # the brand list is the item dimension: one row per brand, so ordering it is a dimension-sized window
    brands = price_cells(spark, d).select("item").distinct().withColumn("_g", F.lit(1))
    nxt = brands.withColumn("nxt", F.lead("item").over(Window.partitionBy("_g").orderBy("item")))
    pairs = nxt.filter("nxt IS NOT NULL").select(F.concat_ws(">", "item", "nxt").alias("pair"), F.col("item").alias("src"), F.col("nxt").alias("dst"))
    series = changes(spark, d).filter("mom IS NOT NULL").select(F.col("item").alias("series"), "m", F.col("mom").alias("v"))
    return written(pairs), written(series)


@query("cross_correlogram", show("SELECT * FROM prof", "pair, lag, n", "rho", CELLS + CHANGES + PAIRS + PROFILE))
def _(spark, d):
    pairs, series = series_pairs(spark, d)
    return timeseries.correlogram(pairs, series, range(-3, 19), 36)


@query(
    "best_lag_alignment",
    show("SELECT *, lead_max IS NULL OR rho0 IS NULL OR rho0 >= lead_max AS aligned FROM best", "pair, best_lag, aligned", "rho_best, lead_max, rho0", CELLS + CHANGES + PAIRS + PROFILE),
)
def _(spark, d):
    pairs, series = series_pairs(spark, d)
    return timeseries.best_lags(timeseries.correlogram(pairs, series, range(-3, 19), 36))


@query(
    "wage_lag_profile",
    show(
        """SELECT pair, arg_max(lag, round(rho, 12) * 1000 - lag * 1e-9) AS best_lag, max(rho) AS rho_best, max(CASE WHEN lag = 0 THEN rho END) AS rho0 FROM (SELECT p.pair, k.lag, count(*) AS n, corr(x.v, y.v) AS rho FROM pairs p CROSS JOIN range(0, 19) AS k(lag)
   JOIN yy x ON x.series = p.src JOIN yy y ON y.series = p.dst AND y.m = x.m + k.lag GROUP BY 1, 2 HAVING count(*) >= 24) AS q GROUP BY 1""",
        "pair, best_lag",
        "rho_best, rho0",
        CELLS + CHANGES + PAIRS + "yy AS (SELECT item AS series, m, yoy AS v FROM chg WHERE yoy IS NOT NULL),",
    ),
)
def _(spark, d):
    pairs, _ = series_pairs(spark, d)
    yoy = changes(spark, d).filter("yoy IS NOT NULL").select(F.col("item").alias("series"), "m", F.col("yoy").alias("v"))
    return timeseries.best_lags(timeseries.correlogram(pairs, yoy, range(0, 19), 24)).select("pair", "best_lag", "rho_best", "rho0")


@query(
    "pair_selection",
    show(
        """SELECT c.dst, c.src, CASE WHEN c.k = 1 AND c.reason IS NULL THEN 'kept' ELSE coalesce(c.reason, 'better twin') END AS outcome FROM (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY dst, reason IS NULL ORDER BY prefer, src) END AS k FROM (
  SELECT p.dst, p.src, p.prefer, CASE WHEN s.n < 82 THEN 'history too short' WHEN (SELECT max(m) FROM ser) - s.lm > 2 THEN 'not current' END AS reason FROM (SELECT dst, src, 0 AS prefer FROM pairs UNION ALL SELECT dst, dst, 1 FROM pairs) AS p
  JOIN (SELECT series, count(*) AS n, max(m) AS lm FROM ser GROUP BY 1) AS s ON s.series = p.src) AS a) AS c""",
        "dst, src, outcome",
        "",
        CELLS + CHANGES + PAIRS,
    ),
)
def _(spark, d):
    pairs, series = series_pairs(spark, d)
    cand = pairs.select("dst", "src", F.lit(0).alias("prefer")).unionByName(pairs.select("dst", F.col("dst").alias("src"), F.lit(1).alias("prefer")))
    spans = series.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("last_m"))
    kept, lost = timeseries.pair_candidates(cand, spans, min_months=82)
    return kept.select("dst", "src", F.lit("kept").alias("outcome")).unionByName(lost.withColumnRenamed("reason", "outcome"))


def projections(spark, d):
    pairs, series = series_pairs(spark, d)
    design = written(timeseries.projection_design(pairs, series, range(13)))
    return pairs, series, design




# each regressor and the response cleared of the other regressor; what is left gives slope, residual and the HAC sum
TWO = """
tw0 AS (SELECT p.pair, y.m, y.v AS y, x.v AS x, l.v AS z FROM pairs p JOIN ser y ON y.series = p.dst JOIN ser x ON x.series = p.src AND x.m = y.m JOIN ser l ON l.series = p.dst AND l.m = y.m - 1),
tw1 AS (SELECT pair, 'x' AS k, m, y, x AS a, z AS b FROM tw0 UNION ALL SELECT pair, 'z', m, y, z, x FROM tw0),
tw2 AS (SELECT pair, k, m, a - regr_intercept(a, b) OVER w - regr_slope(a, b) OVER w * b AS at, y - regr_intercept(y, b) OVER w - regr_slope(y, b) OVER w * b AS yt FROM tw1 WINDOW w AS (PARTITION BY pair, k)),
tw3 AS (SELECT pair, k, row_number() OVER (PARTITION BY pair, k ORDER BY m) AS i, count(*) OVER w AS n, regr_slope(yt, at) OVER w AS beta, at, yt FROM tw2 WINDOW w AS (PARTITION BY pair, k)),
tw4 AS (SELECT *, at * (yt - beta * at) AS s FROM tw3),
two AS (SELECT pair, k, n, beta, sqrt(greatest(v, 0) * n / (n - 3)) / sxx AS se FROM (SELECT pair, k, any_value(n) AS n, any_value(beta) AS beta, sum(at * at) AS sxx FROM tw3 GROUP BY 1, 2) AS f
  JOIN (SELECT a.pair, a.k, sum(a.s * b.s * (1 - abs(a.i - b.i) / 5.0)) AS v FROM tw4 a JOIN tw4 b ON b.pair = a.pair AND b.k = a.k AND abs(a.i - b.i) <= 4 GROUP BY 1, 2) AS h USING (pair, k) WHERE n >= 24),
"""


@query(
    "two_regressor_hac",
    show(
        "SELECT pair, max(n) AS n, max(beta) FILTER (WHERE k = 'x') AS beta_x, max(beta) FILTER (WHERE k = 'z') AS beta_z, max(se) FILTER (WHERE k = 'x') AS se_x, max(se) FILTER (WHERE k = 'z') AS se_z FROM two GROUP BY 1",
        "pair, n",
        "beta_x, beta_z, se_x, se_z",
        CELLS + CHANGES + PAIRS + TWO,
    ),
)
def _(spark, d):
    _, _, design = projections(spark, d)
    rows = design.filter("h = 0 AND cum IS NOT NULL").select("pair", "m", "cum", "x", "y1", F.lit(4).alias("lags"))
    fit = regress.grouped_hac(rows, ["pair"], "cum", ["x", "y1"], "m")
    wide = fit.groupBy("pair", "n").pivot("term", ["x", "y1"]).agg(F.max("beta").alias("beta"), F.max("se").alias("se"))
    return wide.select("pair", "n", F.col("x_beta").alias("beta_x"), F.col("y1_beta").alias("beta_z"), F.col("x_se").alias("se_x"), F.col("y1_se").alias("se_z"))


def pressure_inputs(spark, d):
    pairs, series, design = projections(spark, d)
    betas = written(timeseries.local_projections(design, min_n=36))
    best = timeseries.best_lags(timeseries.correlogram(pairs, series, range(-3, 19), 36))
    b12 = betas.filter("h = 12").select("pair", F.col("beta").alias("beta12"), F.col("se").alias("se12"))
    weights = panel.latest_weights(price_cells(spark, d)).select(F.col("item").alias("dst"), F.col("w").alias("weight"))
    table_ = pairs.join(best.select("pair", "best_lag"), "pair").join(b12, "pair", "left").join(weights, "dst", "left").withColumn("weak", timeseries.weak_link("beta12", "se12"))
    return written(table_), betas, series


def pair_reasons(spark, d, pairs):
    """Brands ending in 7 are overlays; 'Brand#1' stands above 'Brand#12', 'Brand#13', ... in the item tree."""
    items = price_cells(spark, d).select("item").distinct()
    parent = F.when(F.length("item") > 7, F.expr("left(item, length(item) - 1)"))
    tree = items.withColumn("parent", parent)
    known = tree.join(items.withColumnRenamed("item", "parent"), "parent", "left_semi")
    rows = pairs.withColumn("item", F.col("dst")).withColumn("source", F.when(F.col("dst").endswith("7"), "ei").otherwise("wp"))
    return timeseries.in_sum(rows, panel.ancestors(known))


TIMELINE = """
tl AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, CASE o_orderstatus WHEN 'O' THEN 'sec_' || (o_custkey % 7) || '_' ELSE 'act' END || o_orderkey AS action, ((o_custkey % 41) - 20)::DOUBLE AS pp, o_totalprice / 1000 AS value,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' ELSE 'low' END AS confidence FROM orders),
ev AS (SELECT * FROM (SELECT *, abs(pp) * value / 100 AS impulse, row_number() OVER (PARTITION BY m ORDER BY abs(pp) * value / 100 DESC, value DESC, action) AS k FROM tl WHERE confidence IN ('high', 'medium') AND abs(pp) >= 5) AS q WHERE k = 1),
"""


def timeline(spark, d):
    o = table(spark, d, "orders")
    head = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("sec_"), (F.col("o_custkey") % 7).cast("string"), F.lit("_"))).otherwise("act")
    level = F.substring("o_orderpriority", 1, 1)
    return o.select(
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int").alias("m"),
        F.concat(head, F.col("o_orderkey").cast("string")).alias("action"),
        (F.col("o_custkey") % 41 - 20).cast("double").alias("pp"),
        (F.col("o_totalprice") / 1000).alias("value"),
        F.when(level == "1", "high").when(level == "2", "medium").otherwise("low").alias("confidence"),
    )


@query(
    "event_picker",
    show(
        """SELECT e.m, e.action, e.pp, e.value, e.impulse, b.n AS n_bundled, CASE WHEN e.action LIKE 'sec\\_%' ESCAPE '\\' AND (SELECT count(*) FROM tl WHERE tl.m = e.m AND tl.action LIKE 'sec%' AND split_part(tl.action, '_', 2) = split_part(e.action, '_', 2)) >= 3
   THEN 'sec_' || split_part(e.action, '_', 2) ELSE e.action END AS event_label FROM ev e JOIN (SELECT m, count(*) AS n FROM tl GROUP BY 1) AS b USING (m)""",
        "m, action, event_label, n_bundled",
        "pp, value, impulse",
        TIMELINE,
    ),
)
def _(spark, d):
    return timeseries.pick_events(timeline(spark, d))


PANEL_EV = """
ep AS (SELECT e.m AS event_m, c.item, c.m - e.m AS rel, c.mom - a.mu AS demeaned FROM ev e JOIN chg c ON c.m BETWEEN e.m - {lo} AND e.m + {hi} AND c.mom IS NOT NULL
  JOIN LATERAL (SELECT avg(z.mom) AS mu FROM chg z WHERE z.item = c.item AND (z.m - 1) % 12 = (c.m - 1) % 12 AND abs(z.m - e.m) > 12 AND z.mom IS NOT NULL) AS a ON a.mu IS NOT NULL),
"""


def events(spark, d):
    picked = timeseries.pick_events(timeline(spark, d))
    return shared(picked.select(F.col("m").alias("event_m")))


def mom_rows(spark, d):
    return changes(spark, d).select("item", "m", "mom")


@query("event_panel", show("SELECT * FROM ep", "event_m, item, rel", "demeaned", CELLS + CHANGES + TIMELINE + PANEL_EV.format(lo=6, hi=12)))
def _(spark, d):
    return timeseries.event_panel(mom_rows(spark, d), events(spark, d), "mom")


GAPS = """
eg AS (SELECT event_m, rel, sum(demeaned * w) FILTER (WHERE tier = 'high') / sum(w) FILTER (WHERE tier = 'high') - sum(demeaned * w) FILTER (WHERE tier = 'low') / sum(w) FILTER (WHERE tier = 'low') AS gap
  FROM ep JOIN tiers USING (item) JOIN wts ON wts.item = ep.item AND weight_year = (SELECT max(weight_year) FROM wts) GROUP BY 1, 2),
"""


def gap_series(spark, d, low, high):
    rows = timeseries.event_panel(mom_rows(spark, d), events(spark, d), "mom", low, high)
    weights = panel.latest_weights(price_cells(spark, d)).select("item", "w")
    return timeseries.exposure_gap(rows, _tiers(spark, d).join(weights, "item"))


@query(
    "exposure_gap_by_event",
    show("SELECT event_m, rel, gap FROM eg WHERE gap IS NOT NULL", "event_m, rel", "gap", CELLS + CHANGES + WEIGHTS + TIMELINE + PANEL_EV.format(lo=6, hi=12) + TIER + GAPS),
)
def _(spark, d):
    return gap_series(spark, d, -6, 12)


# months with a dummy are fitted exactly; deviations of the others carry the error
EVENT_FIT = """
eb AS (SELECT event_m, count(*) AS n, sum(gap) FILTER (WHERE rel BETWEEN 0 AND 12) AS post, count(*) FILTER (WHERE rel BETWEEN 0 AND 12) AS np, count(*) FILTER (WHERE rel < -6 OR rel > 12) AS n_base,
  avg(gap) FILTER (WHERE rel < -6 OR rel > 12) AS base FROM eg WHERE gap IS NOT NULL GROUP BY 1),
eu AS (SELECT event_m, CASE WHEN rel < -6 OR rel > 12 THEN gap - base ELSE 0 END AS u, row_number() OVER (PARTITION BY event_m ORDER BY rel) AS k FROM eg JOIN eb USING (event_m) WHERE gap IS NOT NULL),
ef AS (SELECT eb.*, greatest(v, 0) AS meat FROM eb JOIN (SELECT a.event_m, sum(a.u * b.u * (1 - abs(a.k - b.k) / 7.0)) AS v FROM eu a JOIN eu b ON b.event_m = a.event_m AND abs(a.k - b.k) <= 6 GROUP BY 1) AS m USING (event_m)
  WHERE n >= 24 AND n_base > 0),
"""


@query(
    "event_regression",
    show(
        "SELECT event_m, n, post - np * base AS cum FROM ef WHERE np > 0",
        "event_m, n",
        "cum",
        CELLS + CHANGES + WEIGHTS + TIMELINE + PANEL_EV.format(lo=24, hi=24) + TIER + GAPS + EVENT_FIT,
    ),
)
def _(spark, d):
    return timeseries.event_regression(gap_series(spark, d, -24, 24)).select("event_m", "n", "cum")


@query(
    "event_coefficients",
    show(
        "SELECT event_m, rel, gap - base AS beta, sqrt(meat) / n_base AS se, CASE WHEN meat > 0 THEN (gap - base) * n_base / sqrt(meat) END AS t FROM eg JOIN ef USING (event_m) WHERE gap IS NOT NULL AND rel BETWEEN -6 AND 12",
        "event_m, rel",
        "beta, se, t",
        CELLS + CHANGES + WEIGHTS + TIMELINE + PANEL_EV.format(lo=24, hi=24) + TIER + GAPS + EVENT_FIT,
    ),
)
def _(spark, d):
    return timeseries.event_coefficients(gap_series(spark, d, -24, 24))


PRE = """
pf AS (SELECT event_m, regr_slope(gap, rel) AS slope, avg(rel) AS mx, avg(gap) AS my, regr_sxx(gap, rel) AS sxx FROM eg WHERE gap IS NOT NULL AND rel BETWEEN -6 AND -1 GROUP BY 1 HAVING count(*) >= 4),
pz AS (SELECT event_m, (rel - mx) * (gap - my - slope * (rel - mx)) AS z, row_number() OVER (PARTITION BY event_m ORDER BY rel) AS k FROM eg JOIN pf USING (event_m) WHERE gap IS NOT NULL AND rel BETWEEN -6 AND -1),
pt AS (SELECT event_m, any_value(slope) AS pre_slope, CASE WHEN any_value(v) > 0 THEN any_value(slope) * any_value(sxx) / sqrt(any_value(v)) END AS pre_t FROM pf
  JOIN (SELECT a.event_m, sum(a.z * b.z * (1 - abs(a.k - b.k) / 3.0)) AS v FROM pz a JOIN pz b ON b.event_m = a.event_m AND abs(a.k - b.k) <= 2 GROUP BY 1) AS m USING (event_m) GROUP BY 1),
"""


@query(
    "event_regression_errors",
    show(
        "SELECT event_m, n, post - np * base AS cum, np * sqrt(meat) / n_base AS cum_se, pre_slope, pre_t, coalesce(abs(pre_t) <= 2, false) AS pre_ok FROM ef LEFT JOIN pt USING (event_m) WHERE np > 0",
        "event_m, n, pre_ok",
        "cum, cum_se, pre_slope, pre_t",
        CELLS + CHANGES + WEIGHTS + TIMELINE + PANEL_EV.format(lo=24, hi=24) + TIER + GAPS + EVENT_FIT + PRE,
    ),
)
def _(spark, d):
    return timeseries.event_regression(gap_series(spark, d, -24, 24))


# four windows from the first month of the cells on: three of 48 months a year apart, and one from the 35th month to the last there is
NET = """
win AS (SELECT unnest(['w1', 'w2', 'w3', 'w4']) AS win, unnest([first, first + 12, first + 24, first + 34]) AS lo, unnest([first + 47, first + 59, first + 71, last]) AS hi FROM (SELECT min(m) AS first, max(m) AS last FROM cells) AS c),
slab0 AS (SELECT win, item AS node, m, mom AS x, w FROM (SELECT wx.*, count(*) OVER (PARTITION BY m) AS k FROM wx WHERE mom IS NOT NULL) AS c JOIN win ON m BETWEEN lo AND hi),
slabs AS (SELECT s.* FROM slab0 s JOIN (SELECT win, node FROM slab0 JOIN win USING (win) GROUP BY 1, 2, lo, hi HAVING count(*) >= 0.8 * (hi - lo + 1)) AS g USING (win, node)),
hl AS (SELECT a.m, 100 * (a.idx / b.idx - 1) AS h FROM (SELECT m, sum(spend) / sum(qty) AS idx FROM cells GROUP BY 1) AS a JOIN (SELECT m, sum(spend) / sum(qty) AS idx FROM cells GROUP BY 1) AS b ON b.m = a.m - 1),
cf0 AS (SELECT s.*, (coalesce(h - (SELECT avg(h) FROM hl), 0) - w / 100 * x) / greatest(1 - w / 100, 1e-6) AS g FROM slabs s LEFT JOIN hl USING (m)),
cf AS (SELECT win, node, m, x - regr_intercept(x, g) OVER p - regr_slope(x, g) OVER p * g AS x FROM cf0 WINDOW p AS (PARTITION BY win, node)),
lc AS (SELECT a.win, a.node AS src, b.node AS dst, k.lag, count(*) AS n, CASE WHEN count(*) >= 30 THEN corr(a.x, b.x) END AS rho FROM cf a CROSS JOIN range(1, 13) AS k(lag) JOIN cf b ON b.win = a.win AND b.m = a.m + k.lag AND b.node <> a.node GROUP BY 1, 2, 3, 4),
bl AS (SELECT win, src, dst, lag, rho, n FROM (SELECT *, row_number() OVER (PARTITION BY win, src, dst ORDER BY round(abs(rho), 12) DESC, lag) AS z FROM lc WHERE rho IS NOT NULL) AS t WHERE z = 1),
"""
N_ALL = CELLS + WEIGHTS + CHANGES + WEIGHTED + NET


def headline(spark, d):
    lv = _published(price_cells(spark, d)).withColumn("_z", F.lit(0))
    return lv.select("m", pct_change("level", calendar_lag("level", "_z", "m", 1)).alias("h")).filter("h IS NOT NULL")


def slabs(spark, d):
    rows = weighted_changes(spark, d).select(F.col("item").alias("node"), "m", F.col("mom").alias("x"), "w")
    first, last = price_cells(spark, d).agg(F.min("m"), F.max("m")).first()
    windows = [("w1", first, first + 47), ("w2", first + 12, first + 59), ("w3", first + 24, first + 71), ("w4", first + 34, last)]
    return network.window_slabs(rows, windows)


def residual_slabs(spark, d):
    return written(network.remove_common_factor(slabs(spark, d), headline(spark, d), 30))


def strongest(spark, d):
    return written(network.strongest_lag(residual_slabs(spark, d), 12, 30))


@query("network_window_nodes", show("SELECT win, node, count(*) AS n FROM slabs GROUP BY 1, 2", "win, node, n", "", N_ALL))
def _(spark, d):
    return slabs(spark, d).groupBy("win", "node").agg(F.count(F.lit(1)).alias("n"))


@query(
    "network_month_coverage",
    show("SELECT m, count(*) AS n FROM wx WHERE mom IS NOT NULL AND m IN (SELECT m FROM wx WHERE mom IS NOT NULL GROUP BY 1 HAVING sum(w) >= 0.6 * (SELECT sum(w) FROM (SELECT item, max(w) AS w FROM wx GROUP BY 1))) GROUP BY 1", "m, n", "", CELLS + WEIGHTS + CHANGES + WEIGHTED),
)
def _(spark, d):
    rows = weighted_changes(spark, d).select(F.col("item").alias("node"), "m", F.col("mom").alias("x"), "w")
    return network.covered_months(rows).filter("x IS NOT NULL").groupBy("m").agg(F.count(F.lit(1)).alias("n"))


@query("common_factor_residuals", show("SELECT * FROM cf", "win, node, m", "x", N_ALL))
def _(spark, d):
    return residual_slabs(spark, d).drop("w")


@query("lagged_correlations", show("SELECT * FROM lc", "win, src, dst, lag, n", "rho", N_ALL))
def _(spark, d):
    return network.lagged_correlations(residual_slabs(spark, d), 12, 30)


@query("strongest_lag_edges", show("SELECT * FROM bl", "win, src, dst, lag, n", "rho", N_ALL))
def _(spark, d):
    return strongest(spark, d)


STABLE = """
scr AS (SELECT *, abs(rho) > 0.30 AS passed FROM bl),
st AS (SELECT src, dst, count(*) AS n_windows, median(lag) AS median_lag, count(*) >= 2 AND min(sign(rho)) = max(sign(rho)) AND greatest(median(lag) - min(lag), max(lag) - median(lag)) <= 2 AS stable FROM scr WHERE passed GROUP BY 1, 2),
se AS (SELECT b.src, b.dst, b.lag, b.rho FROM bl b JOIN st USING (src, dst) WHERE stable AND b.win = 'w4'),
"""


def stable(spark, d):
    best = strongest(spark, d)
    st = written(network.stable_edges(network.screen(best, rho_min=0.30), min_windows=2))
    edges = best.filter("win = 'w4'").join(st.filter("stable").select("src", "dst", "stable"), ["src", "dst"]).select("src", "dst", "lag", "rho", "stable")
    return best, st, shared(edges)


@query("stable_edges", show("SELECT * FROM st", "src, dst, n_windows, stable", "median_lag", N_ALL + STABLE))
def _(spark, d):
    return stable(spark, d)[1]


@query(
    "edge_funnel",
    show(
        "SELECT win, count(*) AS tested, count(*) FILTER (WHERE passed) AS screened, count(*) FILTER (WHERE passed AND (src, dst) IN (SELECT (src, dst) FROM st WHERE stable)) AS stable FROM scr GROUP BY 1",
        "win, tested, screened, stable",
        "",
        N_ALL + STABLE,
    ),
)
def _(spark, d):
    best, st, _ = stable(spark, d)
    rows = network.screen(best, rho_min=0.30).join(st.select("src", "dst", "stable"), ["src", "dst"], "left")
    return rows.groupBy("win").agg(F.count(F.lit(1)).alias("tested"), F.count_if("passed").alias("screened"), F.count_if(F.col("passed") & F.coalesce("stable", F.lit(False))).alias("stable"))


@query(
    "node_degrees",
    show("SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(r) AS upstreamness FROM (SELECT src AS node, 1 AS o, 0 AS i, abs(rho) AS r FROM se UNION ALL SELECT dst, 0, 1, -abs(rho) FROM se) AS t GROUP BY 1", "node, out_degree, in_degree", "upstreamness", N_ALL + STABLE),
)
def _(spark, d):
    return network.degrees(stable(spark, d)[2])


@query(
    "edge_cascade",
    show(
        """SELECT src, 1 AS level, NULL::VARCHAR AS via, dst, lag, lag AS cum_lag, rho, r1 AS rank FROM l1 UNION ALL SELECT src, 2, via, dst, lag, cum_lag, rho, r2 FROM (
  SELECT l1.src, l1.dst AS via, e.dst, e.lag, l1.lag + e.lag AS cum_lag, e.rho, row_number() OVER (PARTITION BY l1.src ORDER BY r1, round(abs(e.rho), 12) DESC, e.dst) AS r2 FROM l1 JOIN bl e ON e.src = l1.dst AND e.win = 'w4'
  WHERE e.dst <> l1.src AND NOT EXISTS (SELECT 1 FROM l1 v WHERE v.src = l1.src AND v.dst = e.dst)) AS q WHERE r2 <= 12""",
        "src, level, via, dst, lag, cum_lag, rank",
        "rho",
        N_ALL + "l1 AS (SELECT * FROM (SELECT src, dst, lag, rho, row_number() OVER (PARTITION BY src ORDER BY round(abs(rho), 12) DESC, dst) AS r1 FROM bl WHERE win = 'w4') AS z WHERE r1 <= 6),",
    ),
)
def _(spark, d):
    best = strongest(spark, d).filter("win = 'w4'").select("src", "dst", "lag", "rho")
    return network.cascade(shared(best))


@query(
    "expected_pair_check",
    show("SELECT p.pair AS name, p.src, p.dst, se.lag, se.rho, se.src IS NOT NULL AS found FROM pairs p LEFT JOIN se ON se.src = p.src AND se.dst = p.dst", "name, src, dst, lag, found", "rho", N_ALL + STABLE + PAIRS),
)
def _(spark, d):
    pairs, _ = series_pairs(spark, d)
    out = network.expected_pairs(pairs.withColumnRenamed("pair", "name"), stable(spark, d)[2])
    return out.select("name", "src", "dst", "lag", "rho", "found")


# the source's lags cleared of the own lags and of each other; F is a form in the inverse of their HAC matrix
_GW = "WINDOW w AS (PARTITION BY win, src, dst)"
GRANGER = f"""
g0 AS (SELECT y.win, s.node AS src, y.node AS dst, y.m, y.x AS y, a.x AS a1, b.x AS a2, c.x AS a3, s.x AS b1, t.x AS b2, u.x AS b3 FROM cf y JOIN cf a ON a.win = y.win AND a.node = y.node AND a.m = y.m - 1
  JOIN cf b ON b.win = y.win AND b.node = y.node AND b.m = y.m - 2 JOIN cf c ON c.win = y.win AND c.node = y.node AND c.m = y.m - 3 JOIN cf s ON s.win = y.win AND s.node <> y.node AND s.m = y.m - 1
  JOIN cf t ON t.win = y.win AND t.node = s.node AND t.m = y.m - 2 JOIN cf u ON u.win = y.win AND u.node = s.node AND u.m = y.m - 3),
g1 AS (SELECT win, src, dst, m, {', '.join(f'{c} - regr_intercept({c}, a1) OVER w - regr_slope({c}, a1) OVER w * a1 AS {c}' for c in ('y', 'a2', 'a3', 'b1', 'b2', 'b3'))} FROM g0 {_GW}),
g2 AS (SELECT win, src, dst, m, {', '.join(f'{c} - regr_slope({c}, a2) OVER w * a2 AS {c}' for c in ('y', 'a3', 'b1', 'b2', 'b3'))} FROM g1 {_GW}),
g3 AS (SELECT win, src, dst, m, {', '.join(f'{c} - regr_slope({c}, a3) OVER w * a3 AS {c}' for c in ('y', 'b1', 'b2', 'b3'))} FROM g2 {_GW}),
g4 AS (SELECT win, src, dst, m, y, b1, b2 - regr_slope(b2, b1) OVER w * b1 AS b2, b3 - regr_slope(b3, b1) OVER w * b1 AS b3 FROM g3 {_GW}),
g5 AS (SELECT win, src, dst, m, y, b1, b2, b3 - regr_slope(b3, b2) OVER w * b2 AS b3 FROM g4 {_GW}),
g6 AS (SELECT *, y - regr_slope(y, b1) OVER w * b1 - regr_slope(y, b2) OVER w * b2 - regr_slope(y, b3) OVER w * b3 AS u, count(*) OVER w AS n, row_number() OVER (PARTITION BY win, src, dst ORDER BY m) AS k FROM g5 {_GW}),
g7 AS (SELECT win, src, dst, k, n, b1 * u AS p, b2 * u AS q, b3 * u AS r, greatest(1, floor(4 * pow(n / 100.0, 2.0 / 9))) AS l FROM g6 WHERE n >= 30),
g8 AS (SELECT a.win, a.src, a.dst, sum(wt * a.p * b.p) AS pp, sum(wt * a.q * b.q) AS qq, sum(wt * a.r * b.r) AS rr, sum(wt * a.p * b.q) AS pq, sum(wt * a.p * b.r) AS pr, sum(wt * a.q * b.r) AS qr
  FROM g7 a JOIN g7 b ON b.win = a.win AND b.src = a.src AND b.dst = a.dst AND abs(a.k - b.k) <= a.l CROSS JOIN LATERAL (SELECT 1 - abs(a.k - b.k) / (a.l + 1) AS wt) GROUP BY 1, 2, 3),
g9 AS (SELECT win, src, dst, any_value(n) AS n, sum(b1 * y) AS e, sum(b2 * y) AS f, sum(b3 * y) AS g FROM g6 GROUP BY 1, 2, 3),
gr AS (SELECT win, src, dst, n, (e * (e * (qq * rr - qr * qr) + f * (pr * qr - pq * rr) + g * (pq * qr - pr * qq)) + f * (e * (pr * qr - pq * rr) + f * (pp * rr - pr * pr) + g * (pq * pr - pp * qr))
  + g * (e * (pq * qr - pr * qq) + f * (pq * pr - pp * qr) + g * (pp * qq - pq * pq))) / (pp * (qq * rr - qr * qr) - pq * (pq * rr - qr * pr) + pr * (pq * qr - qq * pr)) * (n - 7) / n / 3 AS f
  FROM g8 JOIN g9 USING (win, src, dst)),
"""


@query("granger_tests", show("SELECT win, src, dst, f, n FROM gr WHERE f >= 0", "win, src, dst, n", "f", N_ALL + GRANGER))
def _(spark, d):
    """The F statistics; the screen below turns them into p and q."""
    return network.granger(residual_slabs(spark, d), 3, 30).drop("p")


# upper tail of F(3, n - 7): the power series of the incomplete beta function, or of its mirror image where that one falls faster
_SERIES = "exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma(a + b) - lgamma(a) - lgamma(b)) / {a} * list_sum(list_transform(range(0, 600), lambda k: exp(lgamma(a + b + k) - lgamma(a + b) - lgamma({a} + 1 + k) + lgamma({a} + 1) + k * ln({x}))))"
F_TAIL = f"""
ft AS (SELECT *, (n - 7) / 2.0 AS a, 1.5 AS b, (n - 7) / (n - 7 + 3 * f) AS x FROM gr WHERE f >= 0),
pv AS (SELECT win, src, dst, CASE WHEN f = 0 THEN 1 WHEN x < (a + 1) / (a + b + 2) THEN {_SERIES.format(a='a', b='b', x='x')} ELSE 1 - {_SERIES.format(a='b', b='a', x='(1 - x)')} END AS p FROM ft),
qv AS (SELECT *, least(1, min(s) OVER (PARTITION BY win ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q
  FROM (SELECT *, count(*) OVER (PARTITION BY win) * p / count(*) OVER (PARTITION BY win ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM pv) AS t),
"""


@query(
    "granger_false_discovery_screen",
    show(
        "SELECT win, src, dst, bl.lag, bl.rho, p, q, coalesce(abs(bl.rho) > 0.25 OR q < 0.05, false) AS passed FROM bl LEFT JOIN qv USING (win, src, dst)",
        "win, src, dst, lag, passed",
        "rho, p, q",
        N_ALL + GRANGER + F_TAIL,
    ),
)
def _(spark, d):
    rows = residual_slabs(spark, d)
    q = network.benjamini_hochberg(written(network.granger(rows, 3, 30)), "win")
    best = network.strongest_lag(rows, 12, 30).drop("n")
    return network.screen(best.join(q.select("win", "src", "dst", "p", "q"), ["win", "src", "dst"], "left"))


@query(
    "false_discovery_q_values",
    show(
        """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, p, CASE WHEN p IS NOT NULL THEN least(1, min(a) OVER (PARTITION BY fam ORDER BY p DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS q FROM (
  SELECT *, CASE WHEN p IS NOT NULL THEN count(p) OVER (PARTITION BY fam) * p / (count(p) OVER (PARTITION BY fam ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS a FROM (
   SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag AS fam, CASE WHEN l_tax > 0 THEN l_extendedprice / 1e6 END AS p FROM lineitem) AS s) AS t""",
        "l_orderkey, l_linenumber, l_suppkey, l_partkey",
        "q",
    ),
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_returnflag").alias("fam"), F.when(F.col("l_tax") > 0, F.col("l_extendedprice") / 1e6).alias("p")
    )
    return network.benjamini_hochberg(lines, "fam").drop("fam", "p")


# every slope from what the other regressor leaves over; both truncation lags from one lag join
GRID = """
rg0 AS (SELECT c.item, c.m, c.yoy AS y, c.mom, h.h AS head, c.m >= (SELECT (min(m) + max(m)) // 2 FROM hl) AS late FROM chg c JOIN hl h USING (m) WHERE c.yoy IS NOT NULL AND c.mom IS NOT NULL AND h.h IS NOT NULL),
rg1 AS (SELECT item, 'all' AS sample, m, y, mom, head FROM rg0 UNION ALL SELECT item, CASE WHEN late THEN 'late' ELSE 'early' END, m, y, mom, head FROM rg0),
rg2 AS (SELECT item, sample, 'change' AS spec, 'mom' AS term, 2 AS k, m, y, mom - avg(mom) OVER w AS a, y - avg(y) OVER w AS r FROM rg1 WINDOW w AS (PARTITION BY item, sample)
  UNION ALL SELECT item, sample, 'change+headline', 'mom', 3, m, y, mom - regr_intercept(mom, head) OVER w - regr_slope(mom, head) OVER w * head, y - regr_intercept(y, head) OVER w - regr_slope(y, head) OVER w * head FROM rg1 WINDOW w AS (PARTITION BY item, sample)
  UNION ALL SELECT item, sample, 'change+headline', 'head', 3, m, y, head - regr_intercept(head, mom) OVER w - regr_slope(head, mom) OVER w * mom, y - regr_intercept(y, mom) OVER w - regr_slope(y, mom) OVER w * mom FROM rg1 WINDOW w AS (PARTITION BY item, sample)),
rg3 AS (SELECT *, row_number() OVER (PARTITION BY item, sample, spec, term ORDER BY m) AS i, count(*) OVER w AS n, regr_slope(r, a) OVER w AS beta FROM rg2 WINDOW w AS (PARTITION BY item, sample, spec, term)),
rg4 AS (SELECT *, r - beta * a AS u, a * (r - beta * a) AS z, least(12, n // 4) AS l FROM rg3 WHERE n >= 24),
rg5 AS (SELECT p.item, p.sample, p.spec, p.term, sum(p.z * q.z * greatest(0, 1 - abs(p.i - q.i) / (p.l + 1))) AS long_v, sum(p.z * q.z * greatest(0, 1 - abs(p.i - q.i) / 5.0)) AS short_v
  FROM rg4 p JOIN rg4 q ON q.item = p.item AND q.sample = p.sample AND q.spec = p.spec AND q.term = p.term AND abs(p.i - q.i) <= greatest(p.l, 4) GROUP BY 1, 2, 3, 4),
rg6 AS (SELECT item, sample, spec, term, any_value(n) AS n, any_value(beta) AS beta, any_value(n) * 1.0 / (any_value(n) - any_value(k)) AS ss, sum(a * a) AS sxx, 1 - sum(u * u) / (var_pop(y) * count(*)) AS r2 FROM rg4 GROUP BY 1, 2, 3, 4),
rg AS (SELECT item, sample, spec, term, n, beta, sqrt(greatest(long_v, 0) * ss) / sxx AS se_long, sqrt(greatest(short_v, 0) * ss) / sxx AS se_short, r2 FROM rg6 JOIN rg5 USING (item, sample, spec, term)),
"""


@query(
    "regression_grid",
    show(
        """SELECT g.*, CASE WHEN g.spec <> 'change' THEN g.r2 - s.r2 END AS delta_r2, CASE WHEN g.spec <> 'change' THEN pow(w.beta / w.se_long, 2) END AS wald FROM rg g JOIN rg s ON s.item = g.item AND s.sample = g.sample AND s.spec = 'change'
  JOIN rg w ON w.item = g.item AND w.sample = g.sample AND w.term = 'head'""",
        "item, sample, spec, term, n",
        "beta, se_long, se_short, r2, delta_r2, wald",
        N_ALL + GRID,
    ),
)
def _(spark, d):
    """12-month change on the monthly one, with and without the headline, in all months and either half; HAC with 12 lags (at most n/4) and with 4."""
    rows = changes(spark, d).filter("yoy IS NOT NULL AND mom IS NOT NULL").select("item", "m", "yoy", "mom")
    head = shared(headline(spark, d).withColumnRenamed("h", "head"))
    full = with_one_row(rows.join(head, "m"), head.agg(F.floor((F.min("m") + F.max("m")) / 2).alias("_mid")))
    half = F.when(F.col("m") >= F.col("_mid"), "late").otherwise("early")
    cut = full.withColumn("sample", F.explode(F.array(F.lit("all"), half))).drop("_mid")
    sized = cut.groupBy("item", "sample").agg(F.least(F.lit(12), F.floor(F.count(F.lit(1)) / 4)).cast("int").alias("long"))
    cut = written(cut.join(sized, ["item", "sample"]).withColumn("short", F.lit(4)))
    return regress.specification_grid(cut, ["item", "sample"], "yoy", {"change": ["mom"], "change+headline": ["mom", "head"]}, "m", "long", "short")


@query(
    "rolling_24_row_beta",
    show(
        """SELECT item, m, n, beta FROM (SELECT item, c.m, count(*) OVER w AS n, regr_slope(yoy, mom) OVER w AS beta FROM chg c WHERE yoy IS NOT NULL AND mom IS NOT NULL WINDOW w AS (PARTITION BY item ORDER BY c.m ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) AS t WHERE n = 24""",
        "item, m, n",
        "beta",
        CELLS + CHANGES,
    ),
)
def _(spark, d):
    from pyspark.sql import Window

    rows = changes(spark, d).filter("yoy IS NOT NULL AND mom IS NOT NULL")
    w = Window.partitionBy("item").orderBy("m").rowsBetween(-23, 0)
    return rows.select("item", "m", F.count(F.lit(1)).over(w).alias("n"), F.regr_slope("yoy", "mom").over(w).alias("beta")).filter("n = 24")


@query(
    "rolling_24_row_beta_errors",
    show(
        """SELECT item, e AS "end", beta, sqrt(greatest(v, 0) * 24 / 22) / sxx AS se FROM wf JOIN (SELECT a.item, a.e, sum(a.z * b.z * (1 - abs(a.k - b.k) / 7.0)) AS v FROM wz a JOIN wz b ON b.item = a.item AND b.e = a.e AND abs(a.k - b.k) <= 6 GROUP BY 1, 2) AS s USING (item, e)""",
        'item, "end"',
        "beta, se",
        CELLS
        + CHANGES
        + """
wr AS (SELECT item, m, yoy, mom, row_number() OVER (PARTITION BY item ORDER BY m) AS k FROM chg WHERE yoy IS NOT NULL AND mom IS NOT NULL),
wc AS (SELECT e.item, e.m AS e, r.k, r.yoy, r.mom FROM wr e JOIN wr r ON r.item = e.item AND r.k BETWEEN e.k - 23 AND e.k WHERE e.k >= 24),
wf AS (SELECT item, e, avg(yoy) AS my, avg(mom) AS mx, regr_slope(yoy, mom) AS beta, regr_sxx(yoy, mom) AS sxx FROM wc GROUP BY 1, 2),
wz AS (SELECT item, e, k, (mom - mx) * (yoy - my - beta * (mom - mx)) AS z FROM wc JOIN wf USING (item, e)),
""",
    ),
)
def _(spark, d):
    rows = changes(spark, d).filter("yoy IS NOT NULL AND mom IS NOT NULL")
    return regress.rolling_slope_error(rows, "item", "m", "yoy", "mom", rows=24, lags=6).withColumnRenamed("m", "end")


@query(
    "series_side_by_side",
    show(
        """SELECT m, a.level, b.mean_order, c.events, e.lead_level FROM (SELECT m, sum(spend) / sum(qty) AS level FROM cells GROUP BY 1) AS a
  FULL JOIN (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, sum(round(o_totalprice * 100)::BIGINT) / 100.0 / count(*) AS mean_order FROM orders GROUP BY 1) AS b USING (m)
  FULL JOIN (SELECT year(ts) * 12 + month(ts) AS m, count(*)::DOUBLE AS events FROM events GROUP BY 1) AS c USING (m)
  FULL JOIN (SELECT m - 12 AS m, sum(spend) / sum(qty) AS lead_level FROM cells GROUP BY 1) AS e USING (m)""",
        "m",
        "level, mean_order, events, lead_level",
        CELLS,
    ),
)
def _(spark, d):
    """Prices, orders and events by month; no month of any of them is lost."""
    level = price_cells(spark, d).groupBy("m").agg((F.sum("spend") / F.sum("qty")).alias("value"))
    orders = table(spark, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int").alias("m")).agg((F.sum(cents("o_totalprice")) / 100.0 / F.count(F.lit(1))).alias("value"))
    seen = table(spark, d, "events").groupBy((F.year("ts") * 12 + F.month("ts")).cast("int").alias("m")).agg(F.count(F.lit(1)).alias("value"))
    return panel.side_by_side({"level": level, "mean_order": orders, "events": seen, "lead_level": level.withColumn("m", F.col("m") - 12)})


@query(
    "regressor_correlation_matrix",
    show(
        "SELECT item, corr(idx, mom) AS idx_mom, corr(idx, yoy) AS idx_yoy, corr(mom, yoy) AS mom_yoy, avg(yoy) AS mean_yoy, stddev_samp(yoy) AS sd_yoy, min(yoy) AS min_yoy, max(yoy) AS max_yoy FROM chg WHERE mom IS NOT NULL AND yoy IS NOT NULL GROUP BY 1",
        "item",
        "idx_mom, idx_yoy, mom_yoy, mean_yoy, sd_yoy, min_yoy, max_yoy",
        CELLS + CHANGES,
    ),
)
def _(spark, d):
    rows = changes(spark, d).filter("mom IS NOT NULL AND yoy IS NOT NULL")
    return rows.groupBy("item").agg(
        pair_corr("idx", "mom").alias("idx_mom"), pair_corr("idx", "yoy").alias("idx_yoy"), pair_corr("mom", "yoy").alias("mom_yoy"),
        F.avg("yoy").alias("mean_yoy"), F.stddev_samp("yoy").alias("sd_yoy"), F.min("yoy").alias("min_yoy"), F.max("yoy").alias("max_yoy"),
    )


@query(
    "thin_month_removal",
    show(
        "SELECT item, m, cents FROM part_cells WHERE m IN (SELECT m FROM part_cells GROUP BY 1 HAVING count(*) >= 0.5 * (SELECT median(n) FROM (SELECT count(*) AS n FROM part_cells GROUP BY m)))",
        "item, m, cents",
        "",
        "part_cells AS (SELECT l_partkey AS item, year(l_shipdate) * 12 + month(l_shipdate) AS m, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY 1, 2),",
    ),
)
def _(spark, d):
    lines = table(spark, d, "lineitem")
    cells = lines.groupBy(F.col("l_partkey").alias("item"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("m")).agg(F.sum(cents("l_extendedprice")).alias("cents"))
    return timeseries.thin_months(shared(cells), "m", "item")


@query(
    "log_difference_cross_check",
    show(
        """SELECT item, count(*) AS n, corr(x, y) AS rho, avg(x - y) AS mean_diff, avg(abs(x - y)) AS mae FROM (SELECT a.item, 100 * (ln(a.idx) - ln(b.idx)) AS x, 100 * (ln(h.idx) - ln(g.idx)) AS y FROM cells a JOIN cells b ON b.item = a.item AND b.m = a.m - 12
   JOIN (SELECT m, sum(spend) / sum(qty) AS idx FROM cells GROUP BY 1) AS h ON h.m = a.m JOIN (SELECT m, sum(spend) / sum(qty) AS idx FROM cells GROUP BY 1) AS g ON g.m = a.m - 12) AS t GROUP BY 1""",
        "item, n",
        "rho, mean_diff, mae",
        CELLS,
    ),
)
def _(spark, d):
    cells = price_cells(spark, d)
    items = cells.select("item").distinct()
    # the common index is repeated per item through the item's own months, an equality join
    common = cells.select("item", "m").join(_published(cells), "m").select("item", "m", F.col("level").alias("idx"))
    return timeseries.log_change_check(cells.select("item", "m", "idx"), common)


@query(
    "null_persistence_reference",
    show(
        """SELECT item, draw, count(l) AS n, regr_slope(x, l) AS rho FROM (SELECT *, lag(x) OVER (PARTITION BY item, draw ORDER BY k) AS l FROM (
  SELECT item, draw, k, CASE WHEN k >= 12 THEN avg(mom) OVER (PARTITION BY item, draw ORDER BY k ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END AS x FROM (
   SELECT item, draw, mom, row_number() OVER (PARTITION BY item, draw ORDER BY md5(item || '|' || c.m || '|' || draw)) AS k FROM chg c CROSS JOIN range(1, 5) AS d(draw) WHERE mom IS NOT NULL) AS a) AS b) AS e GROUP BY 1, 2""",
        "item, draw, n",
        "rho",
        CELLS + CHANGES,
    ),
)
def _(spark, d):
    """Four random orders of each brand's own monthly changes."""
    return timeseries.null_persistence(changes(spark, d).select("item", "m", "mom"), "item", "m", "mom")


# a tree of product words, types and brands; a node is usable with values in 80 % of the months, up to the last two
UNIVERSE = """
ul AS (SELECT split_part(p_name, ' ', 2) AS a, p_type AS b, p_brand AS c, year(l_shipdate) * 12 + month(l_shipdate) AS m, round(l_extendedprice * 100)::BIGINT AS v FROM lineitem JOIN part ON p_partkey = l_partkey),
ut AS (SELECT 'ALL' AS item, NULL AS parent, m, v FROM ul UNION ALL SELECT a, 'ALL', m, v FROM ul UNION ALL SELECT a || '/' || b, a, m, v FROM ul UNION ALL SELECT a || '/' || b || '/' || c, a || '/' || b, m, v FROM ul),
un AS (SELECT item, any_value(parent) AS parent, sum(v) / 100.0 AS w, item <> 'ALL' AND count(DISTINCT m) >= 0.8 * (SELECT max(m) - min(m) + 1 FROM ul) AND max(m) > (SELECT max(m) - 2 FROM ul) AS usable FROM ut GROUP BY item),
uo AS (SELECT n.*, n.usable AND coalesce(n.w > 0 AND k.cw >= 0.9 * n.w, false) AS opens FROM un n LEFT JOIN (SELECT parent AS item, sum(w) AS cw FROM un WHERE usable GROUP BY 1) AS k USING (item)),
ua AS (SELECT item, parent AS anc, 1 AS depth FROM un WHERE parent IS NOT NULL UNION ALL SELECT x.item, y.parent, 2 FROM un x JOIN un y ON y.item = x.parent WHERE y.parent IS NOT NULL
  UNION ALL SELECT x.item, z.parent, 3 FROM un x JOIN un y ON y.item = x.parent JOIN un z ON z.item = y.parent WHERE z.parent IS NOT NULL),
uu AS (SELECT o.item, o.parent, o.w, t.top IS NULL AS coarse, NOT EXISTS (SELECT 1 FROM ua JOIN un d ON d.item = ua.item WHERE ua.anc = o.item AND d.usable) AS fine, NOT o.opens AND (t.top IS NULL OR t.opened = t.top) AS hybrid
  FROM uo o LEFT JOIN (SELECT ua.item, max(depth) FILTER (WHERE p.usable) AS top, count(*) FILTER (WHERE p.opens) AS opened FROM ua JOIN uo p ON p.item = ua.anc GROUP BY 1) AS t USING (item) WHERE o.usable),
"""


def node_universes(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.split("p_name", " ")[1].alias("a"), F.col("p_type").alias("b"), F.col("p_brand").alias("c"))
    lines = table(spark, d, "lineitem").select("l_partkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("m"), cents("l_extendedprice").alias("v"))
    cells = written(lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("a", "b", "c", "m").agg(F.sum("v").alias("v")))
    path = [F.lit("ALL"), F.col("a"), F.concat_ws("/", "a", "b"), F.concat_ws("/", "a", "b", "c")]
    each = F.array(*[F.struct(item.alias("item"), (path[i - 1] if i else F.lit(None).cast("string")).alias("parent")) for i, item in enumerate(path)])
    months = cells.select("m", "v", F.inline(each)).groupBy("item", "parent", "m").agg(F.sum("v").alias("v"))
    found = months.groupBy("item", "parent").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("last"), (F.sum("v") / 100.0).alias("w"))
    span = cells.agg((F.max("m") - F.min("m") + 1).alias("_span"), F.max("m").alias("_end"))
    usable = (F.col("item") != "ALL") & (F.col("n") >= F.col("_span") * 0.8) & (F.col("last") > F.col("_end") - 2)
    nodes = written(with_one_row(found, span).select("item", "parent", "w", usable.alias("usable")))
    return panel.node_universes(nodes.select("item", "parent"), nodes.select("item", "usable", "w"))


@query("node_universe_coarse", show("SELECT item, parent FROM uu WHERE coarse", "item, parent", "", UNIVERSE))
def _(spark, d):
    return node_universes(spark, d).filter("coarse").select("item", "parent")


@query("node_universe_fine", show("SELECT item, parent FROM uu WHERE fine", "item, parent", "", UNIVERSE))
def _(spark, d):
    return node_universes(spark, d).filter("fine").select("item", "parent")


@query("node_universe_hybrid", show("SELECT item, parent FROM uu WHERE hybrid", "item, parent", "", UNIVERSE))
def _(spark, d):
    return node_universes(spark, d).filter("hybrid").select("item", "parent")


# y on a constant, x and three own lags: x is cleared of the lags one after the other, the rest is a simple slope
ORTHO = """
dsg AS (SELECT p.pair, y.m, x.v AS x, a.v AS y1, b.v AS y2, c.v AS y3 FROM pairs p JOIN ser y ON y.series = p.dst JOIN ser x ON x.series = p.src AND x.m = y.m
  JOIN ser a ON a.series = p.dst AND a.m = y.m - 1 JOIN ser b ON b.series = p.dst AND b.m = y.m - 2 JOIN ser c ON c.series = p.dst AND c.m = y.m - 3),
cum AS (SELECT p.pair, h.h, y.m, sum(z.v) AS cum FROM pairs p CROSS JOIN range(0, 13) AS h(h) JOIN ser y ON y.series = p.dst JOIN ser z ON z.series = p.dst AND z.m BETWEEN y.m AND y.m + h.h GROUP BY 1, 2, 3 HAVING count(*) = h.h + 1),
o0 AS (SELECT h, d.*, cum FROM dsg d JOIN cum USING (pair, m)),
o1 AS (SELECT pair, h, m, cum, y1, y2 - regr_intercept(y2, y1) OVER w - regr_slope(y2, y1) OVER w * y1 AS r2, y3 - regr_intercept(y3, y1) OVER w - regr_slope(y3, y1) OVER w * y1 AS s3, x - regr_intercept(x, y1) OVER w - regr_slope(x, y1) OVER w * y1 AS s1 FROM o0 WINDOW w AS (PARTITION BY pair, h)),
o2 AS (SELECT pair, h, m, cum, s3 - regr_slope(s3, r2) OVER w * r2 AS r3, s1 - regr_slope(s1, r2) OVER w * r2 AS s2 FROM o1 WINDOW w AS (PARTITION BY pair, h)),
o3 AS (SELECT pair, h, m, cum, s2 - regr_slope(s2, r3) OVER w * r3 AS xt FROM o2 WINDOW w AS (PARTITION BY pair, h)),
"""


# what is left of the cumulated response after the lags gives the residuals, and a lag join their HAC sum
PROJ = """
c1 AS (SELECT pair, h, m, y1, cum - regr_intercept(cum, y1) OVER w - regr_slope(cum, y1) OVER w * y1 AS c FROM o0 WINDOW w AS (PARTITION BY pair, h)),
c2 AS (SELECT o1.pair, o1.h, o1.m, c - regr_slope(c, r2) OVER w * r2 AS c FROM c1 JOIN o1 USING (pair, h, m) WINDOW w AS (PARTITION BY o1.pair, o1.h)),
c3 AS (SELECT o2.pair, o2.h, o2.m, c - regr_slope(c, r3) OVER w * r3 AS c FROM c2 JOIN o2 USING (pair, h, m) WINDOW w AS (PARTITION BY o2.pair, o2.h)),
o4 AS (SELECT o3.pair, o3.h, xt, c, row_number() OVER (PARTITION BY o3.pair, o3.h ORDER BY o3.m) AS k, count(*) OVER w AS n, regr_slope(c, xt) OVER w AS beta FROM o3 JOIN c3 USING (pair, h, m) WINDOW w AS (PARTITION BY o3.pair, o3.h)),
o5 AS (SELECT pair, h, k, n, beta, xt, xt * (c - beta * xt) AS z, h + floor(4 * pow(n / 100.0, 2.0 / 9)) AS l FROM o4),
proj AS (SELECT pair, h, n, beta, sqrt(greatest(v, 0) * n / (n - 5)) / sxx AS se FROM (SELECT pair, h, any_value(n) AS n, any_value(beta) AS beta, sum(xt * xt) AS sxx FROM o5 GROUP BY 1, 2) AS f
  JOIN (SELECT a.pair, a.h, sum(a.z * b.z * (1 - abs(a.k - b.k) / (a.l + 1))) AS v FROM o5 a JOIN o5 b ON b.pair = a.pair AND b.h = a.h AND abs(a.k - b.k) <= a.l GROUP BY 1, 2) AS s USING (pair, h) WHERE n >= 36),
"""


@query(
    "cumulative_response_projection",
    show("SELECT pair, h::INT AS h, n, beta, se FROM proj", "pair, h, n", "beta, se", CELLS + CHANGES + PAIRS + ORTHO + PROJ),
)
def _(spark, d):
    return timeseries.local_projections(projections(spark, d)[2], min_n=36)


ROLLED = """
ro0 AS (SELECT o.*, e.e FROM o0 o JOIN (SELECT pair, lo, hi, unnest(range(lo, hi + 1)) AS e FROM (SELECT p.pair, min(y.m) AS lo, max(y.m) AS hi FROM pairs p JOIN ser y ON y.series = p.dst GROUP BY 1) AS s) AS e
  ON e.pair = o.pair AND e.e - e.lo >= 47 AND ((e.e - 1) % 12 + 1 IN (6, 12) OR e.e = e.hi) AND o.m BETWEEN e.e - 47 AND e.e WHERE o.h IN (3, 6, 12)),
ro1 AS (SELECT pair, h, e, m, y2 - regr_intercept(y2, y1) OVER w - regr_slope(y2, y1) OVER w * y1 AS r2, y3 - regr_intercept(y3, y1) OVER w - regr_slope(y3, y1) OVER w * y1 AS s3,
  x - regr_intercept(x, y1) OVER w - regr_slope(x, y1) OVER w * y1 AS x1, cum - regr_intercept(cum, y1) OVER w - regr_slope(cum, y1) OVER w * y1 AS c1 FROM ro0 WINDOW w AS (PARTITION BY pair, h, e)),
ro2 AS (SELECT pair, h, e, m, s3 - regr_slope(s3, r2) OVER w * r2 AS r3, x1 - regr_slope(x1, r2) OVER w * r2 AS x2, c1 - regr_slope(c1, r2) OVER w * r2 AS c2 FROM ro1 WINDOW w AS (PARTITION BY pair, h, e)),
ro3 AS (SELECT pair, h, e, m, x2 - regr_slope(x2, r3) OVER w * r3 AS xt, c2 - regr_slope(c2, r3) OVER w * r3 AS c FROM ro2 WINDOW w AS (PARTITION BY pair, h, e)),
ro4 AS (SELECT pair, h, e, xt, c, row_number() OVER (PARTITION BY pair, h, e ORDER BY m) AS k, count(*) OVER w AS n, regr_slope(c, xt) OVER w AS beta FROM ro3 WINDOW w AS (PARTITION BY pair, h, e)),
ro5 AS (SELECT pair, h, e, k, n, beta, xt, xt * (c - beta * xt) AS z, h + floor(4 * pow(n / 100.0, 2.0 / 9)) AS l FROM ro4 WHERE n >= 30),
rolled AS (SELECT pair, h, e, n, beta, sqrt(greatest(v, 0) * n / (n - 5)) / sxx AS se FROM (SELECT pair, h, e, any_value(n) AS n, any_value(beta) AS beta, sum(xt * xt) AS sxx FROM ro5 GROUP BY 1, 2, 3) AS f
  JOIN (SELECT a.pair, a.h, a.e, sum(a.z * b.z * (1 - abs(a.k - b.k) / (a.l + 1))) AS v FROM ro5 a JOIN ro5 b ON b.pair = a.pair AND b.h = a.h AND b.e = a.e AND abs(a.k - b.k) <= a.l GROUP BY 1, 2, 3) AS s USING (pair, h, e)),
"""


@query(
    "rolling_projection_betas",
    show('SELECT pair, h::INT AS h, e AS "end", n, beta, se FROM rolled', 'pair, h, "end", n', "beta, se", CELLS + CHANGES + PAIRS + ORTHO + ROLLED),
)
def _(spark, d):
    design = projections(spark, d)[2].filter(F.col("h").isin(3, 6, 12))
    return timeseries.rolling_projections(design, months=48, min_n=30)


@query(
    "cumulative_response_betas",
    show("SELECT pair, h::INT AS h, count(*) AS n, regr_slope(cum, xt) AS beta FROM o3 GROUP BY 1, 2 HAVING count(*) >= 36", "pair, h, n", "beta", CELLS + CHANGES + PAIRS + ORTHO),
)
def _(spark, d):
    return timeseries.local_projections(projections(spark, d)[2], min_n=36).select("pair", "h", "n", "beta")


AR3 = f"""
a0 AS (SELECT c.item, c.m AS s, c.mom AS y, b1.mom AS l1, b2.mom AS l2, b3.mom AS l3 FROM chg c JOIN chg b1 ON b1.item = c.item AND b1.m = c.m - 1 JOIN chg b2 ON b2.item = c.item AND b2.m = c.m - 2 JOIN chg b3 ON b3.item = c.item AND b3.m = c.m - 3
  WHERE c.mom IS NOT NULL AND b1.mom IS NOT NULL AND b2.mom IS NOT NULL AND b3.mom IS NOT NULL),
a1 AS (SELECT w.item, w.m, count(*) AS n, avg(y) AS my, avg(l1) AS m1, avg(l2) AS m2, avg(l3) AS m3, covar_pop(l1, l1) AS s11, covar_pop(l2, l2) AS s22, covar_pop(l3, l3) AS s33, covar_pop(l1, l2) AS s12, covar_pop(l1, l3) AS s13, covar_pop(l2, l3) AS s23,
   covar_pop(y, l1) AS c1, covar_pop(y, l2) AS c2, covar_pop(y, l3) AS c3 FROM ends w JOIN a0 ON a0.item = w.item AND a0.s BETWEEN w.m - {W - 1 - 3} AND w.m GROUP BY 1, 2 HAVING count(*) >= 10),
a2 AS (SELECT *, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13) AS det FROM a1),
"""

_AR3_SUM = """(c1 * (s22 * s33 - s23 * s23) - s12 * (c2 * s33 - s23 * c3) + s13 * (c2 * s23 - s22 * c3)
   + s11 * (c2 * s33 - c3 * s23) - c1 * (s12 * s33 - s23 * s13) + s13 * (s12 * c3 - c2 * s13)
   + s11 * (s22 * c3 - s23 * c2) - s12 * (s12 * c3 - c2 * s13) + c1 * (s12 * s23 - s22 * s13)) / det"""


@query(
    "rolling_ar3_sum",
    show(
        f"SELECT item, m, {_AR3_SUM} AS ar3sum FROM a2",
        "item, m",
        "ar3sum",
        CELLS + CHANGES + ENDS + AR3,
    ),
)
def _(spark, d):
    return ar3(spark, d).filter("ar3sum IS NOT NULL")


def ar3(spark, d):
    rows = changes(spark, d).filter("mom IS NOT NULL")
    return timeseries.rolling_ar3_and_errors(rows, "item", "mom", W, MIN, 3).select("item", "m", "ar3sum")


@query(
    "rolling_ar3",
    show(
        f"SELECT item, m, ar3sum FROM ends LEFT JOIN (SELECT item, m, {_AR3_SUM} AS ar3sum FROM a2) AS s USING (item, m)",
        "item, m",
        "ar3sum",
        CELLS + CHANGES + ENDS + AR3,
    ),
)
def _(spark, d):
    """Every window end, also where no sum can be estimated."""
    return ar3(spark, d)


PRESSURE = """
bk AS (SELECT pair, h, beta FROM proj),
pr AS (SELECT p.pair, p.src, p.dst, best_lag, q.beta AS b12, q.se AS se12, wts.w, p.dst LIKE '%7' AS overlay, coalesce(q.beta <= 0 OR q.se <= 0 OR abs(q.beta / q.se) < 1.96, true) AS weak,
  EXISTS (SELECT 1 FROM pairs o WHERE o.dst NOT LIKE '%7' AND length(o.dst) > 7 AND left(o.dst, length(o.dst) - 1) = p.dst) AS covered
  FROM pairs p JOIN best USING (pair) LEFT JOIN proj q ON q.pair = p.pair AND q.h = 12 LEFT JOIN wts ON wts.item = p.dst AND wts.weight_year = (SELECT max(weight_year) FROM wts)),
rs AS (SELECT *, CASE WHEN overlay THEN 'overlay' WHEN weak THEN 'weak' WHEN covered THEN 'covered by a finer pair' WHEN best_lag = 0 THEN 'nothing in the pipe' WHEN w IS NULL THEN 'no weight' END AS reason FROM pr),
pp AS (SELECT * FROM rs WHERE {chosen}),
gm AS (SELECT g.series, g.m, avg(s.v) OVER (PARTITION BY g.series ORDER BY g.m RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS base FROM (SELECT series, unnest(range(min(m), max(m) + 1)) AS m FROM ser GROUP BY 1) AS g LEFT JOIN ser s ON s.series = g.series AND s.m = g.m),
pe AS (SELECT pp.pair, gm.m, b12, se12, coalesce(any_value(mw.w), any_value(pp.w)) AS w, coalesce(sum((s.v - base) * CASE WHEN abs(b12) > 1e-9 THEN greatest(b12 - CASE WHEN k.k >= 12 THEN b12 ELSE coalesce(bk.beta, 0) END, 0) / b12 ELSE 0 END), 0) AS e
  FROM pp JOIN gm ON gm.series = pp.src AND gm.m > (SELECT max(m) FROM ser) - 36 JOIN range(0, 18) AS k(k) ON k.k < best_lag LEFT JOIN bk ON bk.pair = pp.pair AND bk.h = k.k LEFT JOIN ser s ON s.series = pp.src AND s.m = gm.m - k.k
  LEFT JOIN wts mw ON mw.item = pp.dst AND mw.weight_year = (gm.m - 1) // 12 - 1 GROUP BY 1, 2, 3, 4),
"""
IN_SUM = PRESSURE.replace("{chosen}", "reason IS NULL")
PRESSURE = PRESSURE.replace("{chosen}", "best_lag > 0 AND b12 IS NOT NULL AND w IS NOT NULL")


@query(
    "pair_in_sum_reasons",
    show("SELECT pair, dst AS item, reason, reason IS NULL AS in_sum FROM rs", "pair, item, reason, in_sum", "", CELLS + CHANGES + WEIGHTS + PAIRS + PROFILE + ORTHO + PROJ + IN_SUM),
)
def _(spark, d):
    pairs, _, _ = pressure_inputs(spark, d)
    return pair_reasons(spark, d, pairs).select("pair", "item", "reason", "in_sum")


@query(
    "pressure_roll_forward",
    show(
        "SELECT m, sum(e * b12 * w) AS total, sqrt(sum(pow(abs(e) * se12 * w, 2))) AS se_independent, sum(abs(e) * se12 * w) AS se_comonotone FROM pe GROUP BY 1",
        "m",
        "total, se_independent, se_comonotone",
        CELLS + CHANGES + WEIGHTS + PAIRS + PROFILE + ORTHO + PROJ + IN_SUM,
    ),
)
def _(spark, d):
    """Totals over the pairs in the sum, each with its month's own weight."""
    pairs, betas, series = pressure_inputs(spark, d)
    chosen = pair_reasons(spark, d, pairs).filter("in_sum")
    return timeseries.pressure(chosen, betas, series, month_weights(spark, d), 36)[1]


def month_weights(spark, d):
    return panel.december_weights(price_cells(spark, d)).withColumnRenamed("item", "dst")



@query(
    "pressure_totals",
    show("SELECT m, sum(e * b12 * w) AS total, count(*) AS n_pairs FROM pe GROUP BY 1", "m, n_pairs", "total", CELLS + CHANGES + WEIGHTS + PAIRS + PROFILE + ORTHO + PROJ + PRESSURE),
)
def _(spark, d):
    pairs, betas, series = pressure_inputs(spark, d)
    parts, _ = timeseries.pressure(pairs.filter("beta12 IS NOT NULL AND weight IS NOT NULL"), betas, series, month_weights(spark, d), 36)
    return parts.groupBy("m").agg(F.sum("contribution").alias("total"), F.count(F.lit(1)).alias("n_pairs"))

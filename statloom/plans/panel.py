"""Price panel and cross-section queries over order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions.calendar import calendar_lag, label_from_ordinal, month_ordinal, ordinal_year, pct_change
from statloom.operators import panel, xsection
from statloom.operators.ordered import top_k, with_one_row, written
from statloom.plans.registry import query, show
from statloom.plans.tables import CELLS, derived, month_label, price_cells, spend_sum, table

WEIGHTS = """
wts AS (
  SELECT item, y AS weight_year, 100 * spend / sum(spend) OVER (PARTITION BY y) AS w
  FROM (SELECT item, (m - 1) // 12 AS y, spend FROM cells WHERE (m - 1) % 12 + 1 = 12) AS d),
"""

CHANGES = """
chg AS (
  SELECT c.item, c.m, c.idx, CASE WHEN p1.idx > 0 THEN 100 * (c.idx / p1.idx - 1) END AS mom,
         CASE WHEN p.idx > 0 THEN 100 * (c.idx / p.idx - 1) END AS yoy
  FROM cells c LEFT JOIN cells p ON p.item = c.item AND p.m = c.m - 12
  LEFT JOIN cells p1 ON p1.item = c.item AND p1.m = c.m - 1),
"""

WEIGHTED = """
wx AS (
  SELECT chg.item, chg.m, chg.idx, chg.mom, chg.yoy, wts.w, wts.weight_year,
         (m - 1) // 12 - 1 BETWEEN (SELECT min(weight_year) FROM wts) AND (SELECT max(weight_year) FROM wts) AS weight_exact
  FROM chg JOIN wts ON wts.item = chg.item AND wts.weight_year = greatest(least((m - 1) // 12 - 1,
    (SELECT max(weight_year) FROM wts)), (SELECT min(weight_year) FROM wts))),
"""


def changes(spark, d):
    cells = price_cells(spark, d)
    return cells.select(
        "item",
        "m",
        "idx",
        pct_change("idx", calendar_lag("idx", "item", "m", 1)).alias("mom"),
        pct_change("idx", calendar_lag("idx", "item", "m", 12)).alias("yoy"),
    )


def weighted_changes(spark, d):
    return derived(spark, d, "weighted_changes", lambda: _weighted_changes(spark, d))


def _weighted_changes(spark, d):
    weights = panel.december_weights(price_cells(spark, d))
    return panel.clamped_vintage(changes(spark, d).withColumn("year", ordinal_year("m")), weights, "year", "item")


@query(
    "price_panel",
    show(
        """
SELECT a.item, a.ym, a.m, a.idx_nsa, a.idx_sa, 100*(a.idx_sa/nullif(s1.idx_sa,0)-1) AS mom_sa,
  100*(a.idx_nsa/nullif(s1.idx_nsa,0)-1) AS mom_nsa, 100*(a.idx_nsa/nullif(s12.idx_nsa,0)-1) AS yoy,
  100*(pow(a.idx_sa/nullif(s3.idx_sa,0),4)-1) AS ann3m, wts.w AS weight,
  wts.w*(a.idx_nsa/nullif(s12.idx_nsa,0)-1) AS contrib_yoy
FROM (SELECT *, """ + month_label() + """ AS ym FROM wide) a
LEFT JOIN wide s1 ON s1.item=a.item AND s1.m=a.m-1 LEFT JOIN wide s3 ON s3.item=a.item AND s3.m=a.m-3
LEFT JOIN wide s12 ON s12.item=a.item AND s12.m=a.m-12
LEFT JOIN wts ON wts.item=a.item AND wts.weight_year=(a.m-1)//12-1""",
        "item, ym",
        "idx_nsa, idx_sa, mom_sa, mom_nsa, yoy, ann3m, weight, contrib_yoy",
        CELLS + WEIGHTS + """
wide AS (SELECT p_brand AS item, year(l_shipdate)*12+month(l_shipdate) AS m,
  sum(CASE WHEN l_linestatus='F' THEN round(l_extendedprice*100)::BIGINT END)/100.0/sum(CASE WHEN l_linestatus='F' THEN l_quantity END) AS idx_nsa,
  sum(CASE WHEN l_linestatus='O' THEN round(l_extendedprice*100)::BIGINT END)/100.0/sum(CASE WHEN l_linestatus='O' THEN l_quantity END) AS idx_sa
  FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2),""",
    ),
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_linestatus", "l_extendedprice", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("item"))
    obs = (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("item", month_ordinal("l_shipdate").alias("m"), F.when(F.col("l_linestatus") == "O", "S").otherwise("U").alias("seasonal"))
        .agg((spend_sum("l_extendedprice") / F.sum("l_quantity")).alias("idx"))
    )
    out = panel.item_month_panel(obs, panel.december_weights(price_cells(spark, d)))
    return out.select(
        "item", label_from_ordinal("m").alias("ym"), "idx_nsa", "idx_sa", "mom_sa", "mom_nsa", "yoy", "ann3m", "weight", "contrib_yoy"
    )


def _distribution_sql(x: str, source: str, by: str, gate: str) -> str:
    kept = "greatest(least(u, {b}) - greatest(u - s, {a}), 0)"
    trim = ", ".join(
        f"sum(x * {kept.format(a=a / 100, b=1 - a / 100)}) / sum({kept.format(a=a / 100, b=1 - a / 100)}) AS trim{a:02d}" for a in (8, 16)
    )
    pct = ", ".join(f"min(CASE WHEN u >= {p / 100} THEN x END) AS p{p}" for p in (10, 25, 50, 75, 90))
    gt = ", ".join(f"sum(CASE WHEN x > {t} THEN 100 * s ELSE 0 END) AS share_gt{t}" for t in (2, 4, 6))
    return f"""
SELECT {by}, count(*) AS n, sum(w) AS covered, max(mu) AS wmean, sqrt(sum(s*d*d)) AS sd,
  sum(s*d*d*d)/pow(sum(s*d*d),1.5) AS skew, sum(s*d*d*d*d)/pow(sum(s*d*d),2)-3 AS exkurt, {pct}, {trim}, {gt},
  sum(CASE WHEN x < 0 THEN 100 * s ELSE 0 END) AS share_lt0
FROM (SELECT *, x - mu AS d FROM (SELECT {by}, x, w, w/sum(w) OVER (PARTITION BY {by}) AS s,
    sum(w) OVER (PARTITION BY {by} ORDER BY x ROWS UNBOUNDED PRECEDING)/sum(w) OVER (PARTITION BY {by}) AS u,
    sum(w*x) OVER (PARTITION BY {by})/sum(w) OVER (PARTITION BY {by}) AS mu
  FROM (SELECT {by}, {x} AS x, w FROM {source} WHERE {x} IS NOT NULL AND w > 0) AS b) AS c) AS e
GROUP BY {by} HAVING {gate}"""


DIST_COLS = "covered, wmean, sd, skew, exkurt, p10, p25, p50, p75, p90, trim08, trim16, share_gt2, share_gt4, share_gt6, share_lt0"


@query(
    "cross_section_moments",
    show(_distribution_sql("yoy", "wx", "m", "count(*) >= 20 AND sum(w) >= 60"), "m, n", DIST_COLS, CELLS + WEIGHTS + CHANGES + WEIGHTED),
)
def _(spark, d):
    return xsection.weighted_distribution(weighted_changes(spark, d), "m", "yoy", "w")


UNIVERSE_CTE = """
uni AS (SELECT *, 'all' AS universe FROM wx UNION ALL SELECT *, 'ex' FROM wx WHERE NOT (item LIKE 'Brand#1%')),
"""


@query(
    "cross_section_universes",
    show(
        "UNPIVOT (SELECT * EXCLUDE(n), n::DOUBLE AS n FROM ("
        + _distribution_sql("mom", "uni", "universe, m", "count(*) >= 10 AND sum(w) >= CASE WHEN universe = 'ex' THEN 36 ELSE 60 END")
        + ")) ON COLUMNS(* EXCLUDE (universe, m)) INTO NAME measure VALUE value",
        "universe, m, measure",
        "value",
        CELLS + WEIGHTS + CHANGES + WEIGHTED + UNIVERSE_CTE,
    ),
)
def _(spark, d):
    rows = xsection.with_universes(weighted_changes(spark, d), F.col("item").startswith("Brand#1"))
    gate = F.when(F.col("universe") == "ex", 36.0).otherwise(60.0)
    wide = xsection.weighted_distribution(rows, ["universe", "m"], "mom", "w", min_items=10, min_weight=gate)
    wide = wide.withColumn("n", F.col("n").cast("double"))
    measures = [c for c in wide.columns if c not in ("universe", "m")]
    return wide.unpivot(["universe", "m"], measures, "measure", "value").filter(F.col("value").isNotNull())


@query(
    "clamped_weight_vintage",
    show("SELECT item, m, weight_year, weight_exact, w FROM wx", "item, m, weight_year, weight_exact", "w", CELLS + WEIGHTS + CHANGES + WEIGHTED),
)
def _(spark, d):
    return weighted_changes(spark, d).select("item", "m", "weight_year", "weight_exact", "w")


CONTRIB = """
contrib AS (SELECT item, m, w / covered * mom AS c, covered FROM (SELECT *, sum(w) OVER (PARTITION BY m) AS covered
   FROM wx WHERE mom IS NOT NULL AND w > 0) AS t WHERE covered >= 60),
"""


@query("contribution_panel", show("SELECT item, m, covered, c FROM contrib", "item, m", "covered, c", CELLS + WEIGHTS + CHANGES + WEIGHTED + CONTRIB))
def _(spark, d):
    return xsection.contribution_panel(weighted_changes(spark, d), "m", "mom", "w").select("item", "m", "covered", "c")


def _shares(spark, d):
    contrib = written(xsection.contribution_panel(weighted_changes(spark, d), "m", "mom", "w"))
    return xsection.variance_shares(contrib, "item", "m")


VARSHARE = """
tot AS (SELECT m, sum(c) AS x FROM contrib GROUP BY m),
dense AS (SELECT i.item, tot.m, tot.x, coalesce(c.c, 0) AS c0, c.c FROM (SELECT DISTINCT item FROM contrib) AS i CROSS JOIN tot
  LEFT JOIN contrib c ON c.item = i.item AND c.m = tot.m),
vs AS (SELECT * FROM (
  SELECT item, m, 24 AS "window", count(*) OVER f AS n_months, covar_pop(c0, x) OVER f / var_pop(x) OVER f AS share, c
  FROM dense WINDOW f AS (PARTITION BY item ORDER BY m RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT item, m, 60, count(*) OVER f, covar_pop(c0, x) OVER f / var_pop(x) OVER f, c
  FROM dense WINDOW f AS (PARTITION BY item ORDER BY m RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)) AS t
  WHERE n_months >= 0.9 * "window" AND m - (SELECT min(m) FROM tot) >= "window" - 1 AND abs(share) > 1e-12),
"""


@query(
    "variance_shares",
    show('SELECT * FROM vs', 'item, m, "window", n_months', "share, c", CELLS + WEIGHTS + CHANGES + WEIGHTED + CONTRIB + VARSHARE),
)
def _(spark, d):
    return _shares(spark, d)


@query(
    "top_variance_contributors",
    show(
        """SELECT m, "window", item, share, rank FROM (SELECT *, row_number() OVER (PARTITION BY m, "window" ORDER BY round(share, 9) DESC, item) AS rank
  FROM vs) AS t WHERE rank <= 5""",
        'm, "window", item, rank',
        "share",
        CELLS + WEIGHTS + CHANGES + WEIGHTED + CONTRIB + VARSHARE,
    ),
)
def _(spark, d):
    best = top_k(_shares(spark, d), ["m", "window"], [F.round("share", 9).desc(), F.col("item")], 5)
    return best.select("m", "window", "item", "share", "rank")


@query(
    "compound_annual_rate",
    show(
        """SELECT item, m, n_months, CASE WHEN n_months >= 10 THEN (exp(lg * 12.0 / n_months) - 1) * 100 END AS compound FROM (
  SELECT item, m, count(mom) OVER f AS n_months, sum(ln(1 + mom / 100)) OVER f AS lg FROM chg
  WINDOW f AS (PARTITION BY item ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)) AS t""",
        "item, m, n_months",
        "compound",
        CELLS + CHANGES,
    ),
)
def _(spark, d):
    return xsection.compound_trailing(changes(spark, d), "item", "m", "mom").select("item", "m", "n_months", "compound")


@query(
    "ridgeline_extract",
    show(
        """SELECT item, m, yoy, weight_rank FROM (SELECT wx.item, wx.m, yoy, r.weight_rank FROM wx JOIN
  (SELECT item, row_number() OVER (ORDER BY w DESC, item) AS weight_rank FROM wts WHERE weight_year = (SELECT max(weight_year) FROM wts)) AS r
  ON r.item = wx.item WHERE wx.m > (SELECT max(m) FROM wx) - 60 AND yoy IS NOT NULL) AS t WHERE weight_rank <= 10""",
        "item, m, weight_rank",
        "yoy",
        CELLS + WEIGHTS + CHANGES + WEIGHTED,
    ),
)
def _(spark, d):
    rows = weighted_changes(spark, d)
    weights = panel.december_weights(price_cells(spark, d))
    newest = with_one_row(weights, weights.agg(F.max("weight_year").alias("newest"))).filter("weight_year = newest")
    heavy = top_k(newest, "newest", [F.col("w").desc(), F.col("item")], 10, "weight_rank")
    recent = with_one_row(rows, rows.agg(F.max("m").alias("last"))).filter("m > last - 60 AND yoy IS NOT NULL")
    return recent.join(heavy.select("item", "weight_rank"), "item").select("item", "m", "weight_rank", "yoy")

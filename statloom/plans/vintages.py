"""Revision queries: a cell's vintage k uses the order lines numbered up to k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from statloom.operators import vintages
from statloom.operators.ordered import shared, written
from statloom.plans.registry import query, show
from statloom.plans.tables import cents, table
from statloom.session import scratch_folder
from statloom.sources.vintage_store import VintageStore

VINT = """
vc AS (SELECT p_brand AS series, year(l_shipdate) * 12 + month(l_shipdate) AS obs_m, l_linenumber AS k, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS c, sum(l_quantity) AS q
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
lev AS (SELECT series, obs_m, k, obs_m + 3 * k AS vintage_m, make_date((obs_m + 3 * k - 1) // 12, (obs_m + 3 * k - 1) % 12 + 1, 1) AS vintage,
   sum(c) OVER w / 100.0 / sum(q) OVER w AS value FROM vc WINDOW w AS (PARTITION BY series, obs_m ORDER BY k)),
mom AS (SELECT a.series, a.k, a.vintage_m, a.vintage, a.obs_m, 100 * (a.value / b.value - 1) AS mom FROM lev a JOIN lev b ON b.series = a.series AND b.k = a.k AND b.obs_m = a.obs_m - 1),
"""
REV = """
rev AS (SELECT r.*, after_1y - first_print AS rev_1y, latest - first_print AS rev_latest, obs_m >= m0 AS true_first FROM (
   SELECT series, obs_m, arg_min(mom, vintage) AS first_print, min(vintage) AS first_vintage, arg_min(mom, vintage) FILTER (WHERE vintage >= fv + 365) AS after_1y, arg_max(mom, vintage) AS latest, count(*) AS n_vintages
   FROM (SELECT *, min(vintage) OVER (PARTITION BY series, obs_m) AS fv FROM mom) AS a GROUP BY 1, 2) AS r
  JOIN (SELECT series, max(obs_m) AS m0 FROM (SELECT *, min(vintage) OVER (PARTITION BY series) AS v0 FROM mom) AS b WHERE vintage = v0 GROUP BY 1) AS z USING (series)),
"""


def levels(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_linenumber", cents("l_extendedprice").alias("c"), "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("series"))
    obs = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    cells = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("series", obs.alias("obs_m"), F.col("l_linenumber").alias("k")).agg(F.sum("c").alias("c"), F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("series", "obs_m").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    vm = (F.col("obs_m") + F.col("k") * 3).cast("int")
    return written(
        cells.select(
            "series",
            "obs_m",
            "k",
            vm.alias("vintage_m"),
            F.make_date(F.floor((vm - 1) / 12).cast("int"), ((vm - 1) % 12 + 1).cast("int"), F.lit(1)).alias("vintage"),
            (F.sum("c").over(w) / 100.0 / F.sum("q").over(w)).alias("value"),
        )
    )


def moms(spark, d):
    lv = levels(spark, d).withColumnRenamed("vintage_m", "_vm").withColumn("vintage_m", F.col("k"))
    change = vintages.vintage_changes(lv).withColumnRenamed("vintage_m", "k")
    vm = (F.col("obs_m") + F.col("k") * 3).cast("int")
    dated = change.withColumn("vintage_m", vm).withColumn("vintage", F.make_date(F.floor((vm - 1) / 12).cast("int"), ((vm - 1) % 12 + 1).cast("int"), F.lit(1)))
    return written(dated)


@query("vintage_month_changes", show("SELECT * FROM mom", "series, k, vintage_m, obs_m", "mom", VINT))
def _(spark, d):
    return moms(spark, d).select("series", "k", "vintage_m", "obs_m", "mom")


@query(
    "vintage_matrix_long",
    show(
        """SELECT g.series, g.k AS vintage, g.obs_m, l.value, 100 * (l.value / p.value - 1) AS mom FROM (SELECT series, k, unnest(range(min(obs_m), max(obs_m) + 1)) AS obs_m FROM lev GROUP BY 1, 2) AS g
  LEFT JOIN lev l ON l.series = g.series AND l.k = g.k AND l.obs_m = g.obs_m LEFT JOIN lev p ON p.series = g.series AND p.k = g.k AND p.obs_m = g.obs_m - 1""",
        "series, vintage, obs_m",
        "value, mom",
        VINT,
    ),
)
def _(spark, d):
    """A matrix with a column per vintage number, back to rows."""
    wide = levels(spark, d).withColumn("_k", F.concat(F.lit("v"), F.col("k").cast("string"))).groupBy("series", "obs_m").pivot("_k").agg(F.max("value"))
    return vintages.matrix_to_long(wide)


_REV_COLS = "first_print, after_1y, latest, rev_1y, rev_latest"


@query("revision_table", show("SELECT * FROM rev", "series, obs_m, first_vintage, n_vintages, true_first", _REV_COLS, VINT + REV))
def _(spark, d):
    return vintages.revisions(moms(spark, d))


def true_first(spark, d):
    return written(vintages.revisions(moms(spark, d)).filter("true_first"))


@query(
    "revision_transitions",
    show(
        """SELECT series, first, last, n, 1 - sum(CASE WHEN first = last THEN n ELSE 0 END) OVER (PARTITION BY series, first) / sum(n) OVER (PARTITION BY series, first) AS share_changed FROM (
  SELECT series, round(first_print, 1) + 0.0 AS first, round(latest, 1) + 0.0 AS last, count(*) AS n FROM rev WHERE true_first GROUP BY 1, 2, 3) AS t""",
        "series, n",
        "first, last, share_changed",
        VINT + REV,
    ),
)
def _(spark, d):
    return vintages.transitions(true_first(spark, d))


@query(
    "revision_stats_by_year",
    show(
        """SELECT series, (obs_m - 1) // 12 AS year, count(*) AS n, avg(rev_latest) AS mean_rev, avg(abs(rev_latest)) AS mean_abs_rev, stddev_samp(rev_latest) AS sd_rev, avg(abs(rev_1y)) AS mean_abs_rev_1y,
  quantile_cont(rev_latest, 0.1) AS p10, quantile_cont(rev_latest, 0.5) AS p50, quantile_cont(rev_latest, 0.9) AS p90, quantile_cont(abs(rev_latest), 0.9) AS p90_abs,
  avg(CASE WHEN abs(rev_latest) >= 0.1 THEN 1.0 ELSE 0 END) AS share_ge_01, avg(CASE WHEN abs(rev_latest) >= 0.2 THEN 1.0 ELSE 0 END) AS share_ge_02,
  avg(CASE WHEN (first_print > 0) <> (latest > 0) THEN 1.0 ELSE 0 END) AS share_sign_flip FROM rev WHERE true_first AND rev_latest IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3""",
        "series, year, n",
        "mean_rev, mean_abs_rev, sd_rev, mean_abs_rev_1y, p10, p50, p90, p90_abs, share_ge_01, share_ge_02, share_sign_flip",
        VINT + REV,
    ),
)
def _(spark, d):
    rows = true_first(spark, d).withColumn("year", F.floor((F.col("obs_m") - 1) / 12).cast("int"))
    return vintages.revision_stats(rows, ["series", "year"])


SE = """
errs AS (SELECT p_brand AS series, year(l_shipdate) AS year, 10 * stddev_pop(l_discount) * 100 AS se FROM lineitem JOIN part ON p_partkey = l_partkey WHERE year(l_shipdate) IN (1997, 1999, 2000) GROUP BY 1, 2),
"""


@query(
    "trend_noise_flag",
    show(
        """SELECT q.series, obs_m, first_print, trail12, n_trail, e.se, se_year, abs(first_print - trail12) AS gap, abs(first_print - trail12) < 1.5 * e.se AS within FROM (
  SELECT r.series, r.obs_m, r.first_print, avg(b.mom) AS trail12, count(b.mom) AS n_trail, coalesce((SELECT max(year) FROM errs e2 WHERE e2.series = r.series AND e2.year <= (r.obs_m - 1) // 12), (SELECT min(year) FROM errs e2 WHERE e2.series = r.series)) AS se_year
  FROM rev r JOIN mom b ON b.series = r.series AND b.vintage = r.first_vintage AND b.obs_m BETWEEN r.obs_m - 12 AND r.obs_m - 1 WHERE r.true_first GROUP BY r.series, r.obs_m, r.first_print HAVING count(b.mom) >= 2) AS q
  JOIN errs e ON e.series = q.series AND e.year = se_year""",
        "series, obs_m, n_trail, se_year, within",
        "first_print, trail12, se, gap",
        VINT + REV + SE,
    ),
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year"), "l_discount").filter(F.col("year").isin(1997, 1999, 2000))
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("series"))
    errors = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("series", "year").agg((F.stddev_pop("l_discount") * 1000).alias("se"))
    return vintages.trend_noise(true_first(spark, d), moms(spark, d), errors, min_months=2)


@query(
    "revision_fan",
    show("SELECT series, vintage, obs_m, mom FROM mom m WHERE obs_m > (SELECT max(obs_m) FROM mom x WHERE x.series = m.series) - 36", "series, vintage, obs_m", "mom", VINT),
)
def _(spark, d):
    return vintages.fan(moms(spark, d).select("series", "vintage", "obs_m", "mom"))


_PULLS = """
pulls AS (SELECT l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS pull_id, arg_max(l_extendedprice, l_partkey * 100000 + l_extendedprice) AS value, max(l_linestatus) AS stage FROM lineitem GROUP BY 1, 2, 3),
older AS (SELECT k1, k2, arg_max(value, pull_id) AS value, arg_max(stage, pull_id) AS stage FROM pulls WHERE pull_id % 3 <> 0 GROUP BY 1, 2),
newer AS (SELECT k1, k2, arg_max(value, pull_id) AS value, arg_max(stage, pull_id) AS stage FROM pulls GROUP BY 1, 2),
"""


def _observations(spark, d, pulls=None):
    """The newest value and stage of every line over some of the pulls; ties of a pull as in the text."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_suppkey").alias("pull_id"), "l_partkey", "l_extendedprice", "l_linestatus")
    lines = lines if pulls is None else lines.filter(pulls)
    value = F.max_by("l_extendedprice", F.col("l_partkey") * 100000 + F.col("l_extendedprice")).alias("value")
    each = lines.groupBy("k1", "k2", "pull_id").agg(value, F.max("l_linestatus").alias("stage"))
    return vintages.latest_vintage(each, ["k1", "k2"]).drop("pull_id")


def _store(spark, d, **more):
    """A store with two pulls: what two thirds of the suppliers say, then what all say."""
    folder = scratch_folder(spark, "vintages")
    schema = "k1 bigint, k2 bigint, value double" + (", stage string" if more.get("stage") else "")
    eps = more.pop("eps", 1e-9)
    store = VintageStore(spark, folder, schema, ["k1", "k2"], **more)
    store.append(_observations(spark, d, "pull_id % 3 <> 0"), "6", eps)
    store.append(_observations(spark, d), "7", eps)
    return store


@query("latest_vintage_view", show("SELECT * FROM newer", "k1, k2, stage", "value", _PULLS))
def _(spark, d):
    return _store(spark, d, stage="stage").latest().drop("pull_id")


@query(
    "append_changed_observations",
    show("SELECT n.*, '7' AS pull_id FROM newer n LEFT JOIN older o USING (k1, k2) WHERE o.value IS NULL OR abs(n.value - o.value) > 1e-9", "k1, k2, pull_id", "value", _PULLS),
)
def _(spark, d):
    return _store(spark, d).pull("7")


@query(
    "append_on_value_or_stage",
    show(
        "SELECT n.k1, n.k2, n.value, n.stage FROM newer n LEFT JOIN older o USING (k1, k2) WHERE o.value IS NULL OR abs(n.value - o.value) > 20000 OR n.stage IS DISTINCT FROM o.stage",
        "k1, k2, stage",
        "value",
        _PULLS,
    ),
)
def _(spark, d):
    return _store(spark, d, stage="stage", eps=20000).pull("7").drop("pull_id")


@query(
    "vintage_as_of",
    show("SELECT * FROM older", "k1, k2, stage", "value", _PULLS),
)
def _(spark, d):
    """The view as of the first pull, with the second one stored."""
    return _store(spark, d, stage="stage").latest("6").drop("pull_id")


@query(
    "incremental_vintage_ingest",
    show(
        "SELECT l.series, l.obs_m, l.vintage_m, l.value FROM lev l WHERE vintage_m > (SELECT max(vintage_m) FROM lev s WHERE s.series = l.series AND s.vintage_m < 23990 AND s.obs_m >= s.vintage_m - 12) AND obs_m >= vintage_m - 12",
        "series, obs_m, vintage_m",
        "value",
        VINT,
    ),
)
def _(spark, d):
    """The second pull brings all vintages; only those past the stored ones of their series come in."""
    lv = levels(spark, d).select("series", "vintage_m", "obs_m", "value")
    folder = scratch_folder(spark, "vintages")
    store = VintageStore(spark, folder, "series string, vintage_m int, obs_m int, value double", ["series", "vintage_m", "obs_m"], bucket_by=["series"])
    store.append_new_vintages(lv.filter("vintage_m < 23990"), "first", "series", "vintage_m", "obs_m", retain=12)
    store.append_new_vintages(lv, "second", "series", "vintage_m", "obs_m", retain=12)
    return store.pull("second").select("series", "obs_m", "vintage_m", "value")


@query(
    "multi_vintage_cells",
    show("SELECT series, obs_m, count(*) AS n, min(value) AS lo, max(value) AS hi FROM lev GROUP BY 1, 2 HAVING count(*) > 1", "series, obs_m, n", "lo, hi", VINT),
)
def _(spark, d):
    return vintages.multi_vintage_cells(levels(spark, d), ["series", "obs_m"])


@query(
    "level_revision",
    show(
        "SELECT a.*, a.rev_pct - b.rev_pct AS rev_yoy_pp FROM lr a LEFT JOIN lr b ON b.item = a.item AND b.m = a.m - 12",
        "item, m",
        "initial, current, rev_idx, rev_pct, rev_yoy_pp",
        VINT
        + "lr AS (SELECT series AS item, obs_m AS m, max(value) FILTER (WHERE k = 1) AS initial, arg_max(value, k) AS current, arg_max(value, k) - max(value) FILTER (WHERE k = 1) AS rev_idx, 100 * (arg_max(value, k) / max(value) FILTER (WHERE k = 1) - 1) AS rev_pct FROM lev GROUP BY 1, 2 HAVING max(value) FILTER (WHERE k = 1) IS NOT NULL),",
    ),
)
def _(spark, d):
    lv = levels(spark, d)
    vint = lv.select(F.col("series").alias("item"), F.col("obs_m").alias("m"), (F.col("obs_m") + F.col("k") - 1).alias("pub_m"), "value")
    current = lv.groupBy(F.col("series").alias("item"), F.col("obs_m").alias("m")).agg(F.max_by("value", "k").alias("value"))
    return vintages.level_revision(vint, current)


STRESS = """
comp AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS month, o_orderpriority AS component, sum(round(o_totalprice * 100)::BIGINT) / 100.0 / count(*) AS value FROM orders GROUP BY 1, 2),
zz AS (SELECT month, c.component, substr(c.component, 1, 1) IN ('1', '2') AS dom, (value - mu) / sd AS z, value - mu AS pp FROM comp c JOIN (SELECT component, avg(value) AS mu, stddev_pop(value) AS sd FROM comp
   WHERE month BETWEEN 23953 AND 23964 GROUP BY 1 HAVING count(*) >= 6 AND stddev_pop(value) > 0) AS b ON b.component = c.component),
"""


@query(
    "stress_composite",
    show(
        "SELECT month, component, z, pp FROM zz UNION ALL SELECT month, '_composite', avg(z), avg(pp) FROM (SELECT month, dom, avg(z) AS z, avg(pp) AS pp FROM zz GROUP BY 1, 2) AS d GROUP BY 1",
        "month, component",
        "z, pp",
        STRESS,
    ),
)
def _(spark, d):
    orders = table(spark, d, "orders")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    comp = orders.groupBy(month.alias("month"), F.col("o_orderpriority").alias("component")).agg((F.sum(cents("o_totalprice")) / 100.0 / F.count(F.lit(1))).alias("value"))
    comp = shared(comp)
    domains = comp.select("component").distinct().withColumn("domain", F.substring("component", 1, 1).isin("1", "2"))
    return vintages.stress_composite(comp, F.col("month").between(23953, 23964), domains)


@query(
    "derived_share_identity",
    show(
        """SELECT month, urgent, rest, total, urgent * 100.0 / total AS share, urgent + rest = total AS identity_ok FROM (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS month, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent,
  count(*) FILTER (WHERE o_orderpriority NOT LIKE '1%') AS rest, count(*) AS total FROM orders GROUP BY 1) AS t""",
        "month, urgent, rest, total, identity_ok",
        "share",
    ),
)
def _(spark, d):
    orders = table(spark, d, "orders")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("rest")
    wide = orders.withColumn("kind", kind).groupBy(month.alias("month")).pivot("kind", ["urgent", "rest"]).count()
    total = orders.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("total"))
    out = wide.fillna(0).join(total, "month")
    return out.withColumn("share", F.col("urgent") * 100.0 / F.col("total")).withColumn("identity_ok", F.col("urgent") + F.col("rest") == F.col("total"))


@query(
    "standard_error_ratio",
    show(
        "SELECT e.series, e.year, e.se, e.se / b.se AS ratio FROM errs e JOIN (SELECT series, se FROM errs WHERE year = 1997) AS b USING (series)",
        "series, year",
        "se, ratio",
        SE.replace("WHERE year(l_shipdate) IN (1997, 1999, 2000)", ""),
    ),
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year"), "l_discount")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("series"))
    errors = shared(lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("series", "year").agg((F.stddev_pop("l_discount") * 1000).alias("se")))
    base = errors.groupBy("series").agg(F.max(F.when(F.col("year") == 1997, F.col("se"))).alias("_b"))
    return errors.join(base, "series").filter("_b IS NOT NULL").select("series", "year", "se", (F.col("se") / F.col("_b")).alias("ratio"))

"""Metro queries: nations as metros, order values as prices and wages."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import metro
from statloom.operators.ordered import shared
from statloom.plans.registry import query, show
from statloom.plans.tables import cents, table

# odd-numbered nations publish only in odd months, nations below 6 in even ones
METRO = """
om AS (SELECT n_name AS metro, n_nationkey AS k, year(o_orderdate) * 12 + month(o_orderdate) AS m, sum(round(o_totalprice * 100)::BIGINT) / 100.0 / count(*) AS v,
   sum(CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice * 100)::BIGINT END) / 100.0 / nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS wv, count(*) AS n
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3),
pop AS (SELECT n_name AS metro, count(*) AS pop FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
px AS (SELECT metro, m, v FROM om WHERE k >= 12 OR (k < 6 AND m % 2 = 0) OR (k BETWEEN 6 AND 11 AND m % 2 = 1)),
py AS (SELECT a.metro, a.m, a.v, 100 * (a.v / b.v - 1) AS yoy FROM px a LEFT JOIN px b ON b.metro = a.metro AND b.m = a.m - 12),
"""


def cells(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", cents("o_totalprice").alias("c"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("metro"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int").alias("m"))
    open_ = F.col("o_orderstatus") == "O"
    agg = rows.agg(
        (F.sum("c") / 100.0 / F.count(F.lit(1))).alias("v"), F.try_divide(F.sum(F.when(open_, F.col("c"))) / 100.0, F.count_if(open_)).alias("wv"), F.count(F.lit(1)).alias("n")
    )
    return shared(agg.join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_nationkey", "k"))


def prices(spark, d):
    k, m = F.col("k"), F.col("m")
    rows = cells(spark, d).filter((k >= 12) | ((k < 6) & (m % 2 == 0)) | (k.between(6, 11) & (m % 2 == 1)))
    return shared(metro.sparse_yoy(rows.select("metro", "m", "v"), "metro", "v"))


def population(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("metro")).agg(F.count(F.lit(1)).alias("pop"))


@query("metro_inflation", show("SELECT metro, m, v, yoy FROM py", "metro, m", "v, yoy", METRO))
def _(spark, d):
    return prices(spark, d)


@query(
    "metro_dispersion",
    show(
        """SELECT *, abs(comp_delta) > 0.3 AS comp_flag FROM (SELECT m, n, mean, sd, min_metro, min_yoy, max_metro, max_yoy, max_yoy - min_yoy AS range, CASE WHEN count(*) OVER w = 3 THEN mean - avg(mean) OVER w END AS comp_delta FROM (
  SELECT m, count(*) AS n, sum(pop * yoy) / sum(pop) AS mean, sqrt(sum(pop * pow(yoy - mu, 2)) / sum(pop)) AS sd, first(metro ORDER BY yoy, metro) AS min_metro, min(yoy) AS min_yoy, first(metro ORDER BY yoy DESC, metro DESC) AS max_metro, max(yoy) AS max_yoy
   FROM (SELECT py.*, pop, sum(pop * yoy) OVER (PARTITION BY m) / sum(pop) OVER (PARTITION BY m) AS mu FROM py JOIN pop USING (metro) WHERE yoy IS NOT NULL) AS a GROUP BY 1 HAVING count(*) >= 8) AS b WINDOW w AS (ORDER BY m RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS c""",
        "m, n, min_metro, max_metro, comp_flag",
        "mean, sd, min_yoy, max_yoy, range, comp_delta",
        METRO,
    ),
)
def _(spark, d):
    return metro.dispersion(prices(spark, d).join(population(spark, d), "metro"))


SCHED = """
sc AS (SELECT metro, n, odd, CASE WHEN n >= 0.9 * possible THEN 'monthly' WHEN odd > n - odd THEN 'odd' ELSE 'even' END AS schedule FROM (
  SELECT metro, count(*) AS n, count(*) FILTER (WHERE ((m - 1) % 12 + 1) % 2 = 1) AS odd, any_value(last) - greatest(any_value(last) - 59, min(m)) + 1
    - CASE WHEN 24000 BETWEEN greatest(any_value(last) - 59, min(m)) AND any_value(last) THEN 1 ELSE 0 END AS possible
  FROM px CROSS JOIN (SELECT max(m) AS last FROM px) AS l WHERE m > last - 60 AND m <> 24000 GROUP BY 1) AS q),
"""


@query("metro_schedule", show("SELECT * FROM sc", "metro, n, odd, schedule", "", METRO + SCHED))
def _(spark, d):
    return metro.schedule(prices(spark, d).select("metro", "m"), 60, 24000)


@query(
    "metro_area_dimension",
    show(
        "SELECT metro, min(m) AS first_m, max(m) AS last_m, any_value(schedule) AS schedule, metro IN (SELECT n_name FROM nation WHERE n_regionkey = 3) AS approximate FROM px LEFT JOIN sc USING (metro) GROUP BY metro",
        "metro, first_m, last_m, schedule, approximate",
        "",
        METRO + SCHED,
    ),
)
def _(spark, d):
    rows = prices(spark, d).select("metro", "m")
    approx = table(spark, d, "nation").filter("n_regionkey = 3").select(F.col("n_name").alias("metro"))
    return metro.area_dimension(rows, metro.schedule(rows, 60, 24000), approx)


WAGE = """
wq0 AS (SELECT metro, (m - 1) // 3 AS q, own, sum(x * n) / sum(n) AS w FROM (SELECT metro, m, n, unnest(['0', '5']) AS own, unnest([v, CASE WHEN k % 4 <> 0 THEN wv END]) AS x FROM om) AS t WHERE x IS NOT NULL GROUP BY 1, 2, 3),
wq AS (SELECT a.metro, a.q, a.own, 100 * (a.w / b.w - 1) AS yoy FROM wq0 a JOIN wq0 b ON b.metro = a.metro AND b.own = a.own AND b.q = a.q - 4),
"""


def wages(spark, d):
    from statloom.functions.calendar import calendar_lag

    both = F.array(F.struct(F.lit("0").alias("own"), F.col("v").alias("x")), F.struct(F.lit("5").alias("own"), F.when(F.col("k") % 4 != 0, F.col("wv")).alias("x")))
    long = cells(spark, d).select("metro", F.floor((F.col("m") - 1) / 3).cast("int").alias("q"), "n", F.inline(both)).filter("x IS NOT NULL")
    q = long.groupBy("metro", "q", "own").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("w"))
    return q.withColumn("yoy", (F.col("w") / calendar_lag("w", ["metro", "own"], "q", 4) - 1) * 100).filter("yoy IS NOT NULL").select("metro", "q", "own", "yoy")


@query(
    "metro_real_wages",
    show(
        """SELECT w.metro, w.q, coalesce(p5, p0) AS wage_yoy, CASE WHEN p5 IS NOT NULL THEN '5' ELSE '0' END AS wage_own, c.yoy AS cpi_yoy, c.m AS month_used, coalesce(p5, p0) - c.yoy AS real_yoy FROM (SELECT metro, q, max(yoy) FILTER (WHERE own = '5') AS p5, max(yoy) FILTER (WHERE own = '0') AS p0 FROM wq GROUP BY 1, 2) AS w
  JOIN (SELECT metro, (m - 1) // 3 AS q, max(m) AS m, arg_max(yoy, m) AS yoy FROM py WHERE yoy IS NOT NULL GROUP BY 1, 2) AS c ON c.metro = w.metro AND c.q = w.q""",
        "metro, q, wage_own, month_used",
        "wage_yoy, cpi_yoy, real_yoy",
        METRO + WAGE,
    ),
)
def _(spark, d):
    return metro.real_wages(wages(spark, d), prices(spark, d))


@query(
    "metro_shelter_gap",
    show(
        "SELECT a.metro, a.m, a.yoy, b.yoy AS market_yoy_lagged, a.yoy - b.yoy AS gap FROM py a JOIN oy b ON b.metro = a.metro AND b.m = a.m - 12 WHERE a.yoy IS NOT NULL AND b.yoy IS NOT NULL",
        "metro, m",
        "yoy, market_yoy_lagged, gap",
        METRO + "oy AS (SELECT a.metro, a.m, 100 * (a.wv / b.wv - 1) AS yoy FROM om a JOIN om b ON b.metro = a.metro AND b.m = a.m - 12),",
    ),
)
def _(spark, d):
    market = metro.sparse_yoy(cells(spark, d).select("metro", "m", "wv"), "metro", "wv")
    return metro.shelter_gap(prices(spark, d).select("metro", "m", "yoy"), market.select("metro", "m", "yoy"))


@query(
    "metro_recent_extract",
    show(
        "SELECT metro, max(m) AS last_m, arg_max(n, m) AS last_value, count(*) AS n, to_json(list(n ORDER BY m)) AS series FROM om a WHERE m > (SELECT max(m) FROM om b WHERE b.metro = a.metro) - 24 GROUP BY 1",
        "metro, last_m, last_value, n, series",
        "",
        METRO,
    ),
)
def _(spark, d):
    rows = cells(spark, d).select("metro", "m", F.col("n").alias("value"))
    return metro.recent_extract(rows, ["metro"], 24).withColumn("series", F.to_json("series"))

"""Cohort queries: nations as units, balance bands as age bins, order years as censuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import cohort
from statloom.operators.ordered import shared
from statloom.plans.registry import query, show
from statloom.plans.tables import table

_BINS_SQL = "[" + ", ".join(f"'{b}'" for b in cohort.STANDARD_BINS) + "]"
_SPEC_SQL = ", ".join(
    f"('{end}', '{band}', '{label}', {label.split('-')[0]}, {label.split('-')[1]})"
    for label, sources, target in cohort.cohort_specs()
    for end, bands in (("t0", sources), ("t1", [target]))
    for band in bands
)

POP = f"""
pop AS (
  SELECT year(o_orderdate) AS year, printf('%02d', c_nationkey) AS geoid, CASE WHEN c_mktsegment < 'H' THEN 'F' ELSE 'M' END AS sex,
    ({_BINS_SQL})[least(17, greatest(0, floor((c_acctbal + 1000) / 612)))::INT + 1] AS age_bin,
    count(*) AS count, count(*) FILTER (WHERE o_orderstatus = 'P' AND year(o_orderdate) < 1998) AS gq_count
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
"""

UNITS = """
unitpop AS (
  SELECT year, coalesce(g.gid, p.geoid) AS unit, sex, age_bin, min(coalesce(g.gid, n_name)) AS name, sum(count)::BIGINT AS count, sum(gq_count)::BIGINT AS gq_count
  FROM (SELECT year, CASE WHEN geoid = '24' THEN '23' ELSE geoid END AS geoid, sex, age_bin, count, gq_count, n_name
        FROM pop JOIN nation ON n_nationkey = geoid::INT) AS p
  LEFT JOIN (VALUES ('03', 'MG-1'), ('04', 'MG-1'), ('05', 'MG-2'), ('06', 'MG-2')) AS g(geoid, gid) ON g.geoid = p.geoid GROUP BY 1, 2, 3, 4),
"""

FLOWS = f"""
periods AS (SELECT year AS t0, lead(year) OVER (ORDER BY year) AS t1 FROM (SELECT DISTINCT year FROM unitpop)),
spec AS (SELECT t0 || '-' || t1 AS period, CASE WHEN e = 't0' THEN t0 ELSE t1 END AS year, e, age_bin, cohort_age_at_t0, (t0 - high - 1) || '-' || (t0 - low) AS birth_years
  FROM periods CROSS JOIN (VALUES {_SPEC_SQL}) AS s(e, age_bin, cohort_age_at_t0, low, high) WHERE t1 IS NOT NULL),
common AS (SELECT period, unit FROM unitpop JOIN spec USING (year) GROUP BY 1, 2 HAVING count(DISTINCT e) = 2),
gqy AS (SELECT period, bool_and(gq > 0) AS house FROM (SELECT period, e, sum(gq_count) AS gq FROM unitpop JOIN (SELECT DISTINCT period, year, e FROM spec) USING (year) GROUP BY 1, 2) GROUP BY 1),
cells AS (
  SELECT period, house, unit, cohort_age_at_t0, birth_years, sex,
    coalesce(sum(CASE WHEN e = 't0' THEN CASE WHEN house THEN greatest(count - gq_count, 0) ELSE count END END), 0)::DOUBLE AS count_t0,
    coalesce(sum(CASE WHEN e = 't1' THEN CASE WHEN house THEN greatest(count - gq_count, 0) ELSE count END END), 0)::DOUBLE AS count_t1
  FROM unitpop JOIN spec USING (year, age_bin) JOIN common USING (period, unit) JOIN gqy USING (period) GROUP BY ALL),
flows AS (
  SELECT period, CASE WHEN house THEN 'household' ELSE 'total' END AS basis, unit, cohort_age_at_t0, birth_years, sex, count_t0, count_t1,
    n1 / n0 AS national_ratio, count_t0 * (n1 / n0) AS expected_t1, count_t1 - count_t0 * (n1 / n0) AS net_residual,
    CASE WHEN count_t0 * (n1 / n0) > 0 THEN (count_t1 - count_t0 * (n1 / n0)) / (count_t0 * (n1 / n0)) END AS net_migration_rate,
    CASE WHEN count_t0 * (n1 / n0) < 100 THEN 'low' ELSE 'ok' END AS reliability
  FROM (SELECT *, sum(count_t0) OVER g AS n0, sum(count_t1) OVER g AS n1 FROM cells WINDOW g AS (PARTITION BY period, cohort_age_at_t0, sex)) WHERE n0 > 0),
"""


def population(spark, d):
    people = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    band = F.least(F.lit(17), F.greatest(F.lit(0), F.floor((F.col("c_acctbal") + 1000) / 612))).cast("int")
    bins = F.array(*[F.lit(b) for b in cohort.STANDARD_BINS])
    year = F.year("o_orderdate")
    return (
        orders.join(people, orders.o_custkey == people.c_custkey)
        .groupBy(
            year.alias("year"),
            F.format_string("%02d", "c_nationkey").alias("geoid"),
            F.when(F.col("c_mktsegment") < "H", "F").otherwise("M").alias("sex"),
            F.element_at(bins, band + 1).alias("age_bin"),
        )
        .agg(F.count(F.lit(1)).alias("count"), F.count_if((F.col("o_orderstatus") == "P") & (year < 1998)).alias("gq_count"))
    )


def crosswalked(spark, d):
    nation = table(spark, d, "nation").select(F.format_string("%02d", "n_nationkey").alias("geoid"), F.col("n_name").alias("name"))
    renames = spark.createDataFrame([("24", "23")], "geoid string, new_geoid string")
    groups = spark.createDataFrame([("03", "MG-1"), ("04", "MG-1"), ("05", "MG-2"), ("06", "MG-2")], "geoid string, group_id string")
    return shared(cohort.apply_crosswalk(population(spark, d).join(nation, "geoid"), renames, groups))


def flows(spark, d):
    people = crosswalked(spark, d)
    return cohort.trace(people, cohort.consecutive_periods(people))


@query("cohort_crosswalk", show("SELECT * FROM unitpop", "year, unit, sex, age_bin, name, count, gq_count", "", POP + UNITS))
def _(spark, d):
    return crosswalked(spark, d).select("year", "unit", "sex", "age_bin", "name", "count", "gq_count")


@query(
    "cohort_trace",
    show(
        "SELECT * FROM flows",
        "period, basis, unit, cohort_age_at_t0, birth_years, sex, reliability",
        "count_t0, count_t1, national_ratio, expected_t1, net_residual, net_migration_rate",
        POP + UNITS + FLOWS,
    ),
)
def _(spark, d):
    return flows(spark, d)


@query(
    "cohort_both_sexes",
    show(
        """SELECT *, CASE WHEN expected_t1 > 0 THEN net_residual / expected_t1 END AS net_migration_rate FROM (
  SELECT period, unit, cohort_age_at_t0, birth_years, sum(count_t0) AS count_t0, sum(count_t1) AS count_t1, sum(expected_t1) AS expected_t1,
    sum(net_residual) AS net_residual FROM flows GROUP BY 1, 2, 3, 4) AS s""",
        "period, unit, cohort_age_at_t0, birth_years",
        "count_t0, count_t1, expected_t1, net_residual, net_migration_rate",
        POP + UNITS + FLOWS,
    ),
)
def _(spark, d):
    return cohort.both_sexes(flows(spark, d))


@query(
    "cohort_young_adults",
    show(
        """SELECT period, unit, name, side, rank, expected_t1, count_t1, net_residual, net_migration_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY period, side ORDER BY CASE WHEN side = 'top' THEN -round(net_migration_rate, 9) ELSE round(net_migration_rate, 9) END, unit) AS rank
  FROM (SELECT s.*, net_residual / expected_t1 AS net_migration_rate, n.name, unnest(['top', 'bottom']) AS side FROM (
    SELECT period, unit, sum(expected_t1) AS expected_t1, sum(count_t1) AS count_t1, sum(net_residual) AS net_residual
    FROM flows WHERE cohort_age_at_t0 IN ('10-14', '15-19') GROUP BY 1, 2 HAVING sum(expected_t1) >= 10) AS s
    LEFT JOIN (SELECT unit, arg_max(name, year) AS name FROM unitpop GROUP BY 1) AS n USING (unit)) AS t) AS r WHERE rank <= 5""",
        "period, unit, name, side, rank",
        "expected_t1, count_t1, net_residual, net_migration_rate",
        POP + UNITS + FLOWS,
    ),
)
def _(spark, d):
    people = crosswalked(spark, d)
    return cohort.young_adults(flows(spark, d), cohort.latest_names(people), k=5, min_expected=10)


@query(
    "cohort_one_ended_units",
    show(
        f"""SELECT period, unit, CASE WHEN min(e) = 't0' THEN 't1' ELSE 't0' END AS missing_end FROM (
   SELECT DISTINCT s.period, s.e, u.unit FROM sparse u JOIN spec s USING (year)) AS q GROUP BY 1, 2 HAVING count(*) = 1""",
        "period, unit, missing_end",
        "",
        POP + UNITS + FLOWS + "sparse AS (SELECT year, unit || '/' || age_bin || '/' || sex AS unit FROM unitpop),",
    ),
)
def _(spark, d):
    cells = crosswalked(spark, d).select("year", F.concat_ws("/", "unit", "age_bin", "sex").alias("unit"))
    return cohort.dropped_units(cells, cohort.consecutive_periods(cells))


@query(
    "cohort_baseline_splice",
    show(
        """SELECT year, unit, sex, age_bin, count FROM unitpop WHERE NOT (year = 1997 AND unit IN ('00', '01'))
  UNION ALL SELECT 1997, unit, sex, age_bin, count + 1 FROM unitpop WHERE year = 1996 AND unit IN ('00', '01')""",
        "year, unit, sex, age_bin, count",
        "",
        POP + UNITS,
    ),
)
def _(spark, d):
    people = crosswalked(spark, d).select("year", "unit", "sex", "age_bin", "count")
    baseline = people.filter((F.col("year") == 1996) & F.col("unit").isin("00", "01")).withColumn("year", F.lit(1997)).withColumn("count", F.col("count") + 1)
    return cohort.splice_replace(people, baseline, 1997)


_FOLD = "CASE WHEN age_bin IN ('75-79', '80-84') THEN '75-84' ELSE age_bin END"


@query(
    "cohort_top_bin_splice",
    show(
        f"""SELECT unit, sex, year, sum(CASE WHEN src = 'base' THEN count END)::BIGINT AS base_sum, sum(CASE WHEN src = 'top' THEN count END)::BIGINT AS top_sum,
  sum(CASE WHEN src = 'base' THEN count END) <> sum(CASE WHEN src = 'top' THEN count END) AS mismatch, sum(CASE WHEN src = 'top' THEN count END) IS NULL AS missing
  FROM (SELECT unit, sex, year, {_FOLD} AS b, count, 'base' AS src FROM unitpop UNION ALL SELECT unit, sex, year - 1, {_FOLD}, count, 'top' FROM unitpop) AS t
  WHERE b IN ('75-84', '85+') GROUP BY 1, 2, 3 HAVING base_sum IS NOT NULL""",
        "unit, sex, year, base_sum, top_sum, mismatch, missing",
        "",
        POP + UNITS,
    ),
)
def _(spark, d):
    fold = F.when(F.col("age_bin").isin("75-79", "80-84"), "75-84").otherwise(F.col("age_bin"))
    people = crosswalked(spark, d).groupBy("year", "unit", "sex", fold.alias("age_bin")).agg(F.sum("count").alias("count"))
    # every year's table with the oldest bins of the next one
    return cohort.splice_top_bins(people, people.withColumn("year", F.col("year") - 1), by=("year",))[1]


@query(
    "cohort_anchor_check",
    show(
        """SELECT year, ours, published, ours - published AS diff, abs(ours - published) <= tolerance AS ok FROM (
  SELECT year, sum(count)::BIGINT AS ours FROM unitpop GROUP BY 1) AS a JOIN (
  SELECT year(o_orderdate) AS year, count(*) AS published, CASE WHEN year(o_orderdate) = 1996 THEN 100 ELSE 0 END AS tolerance FROM orders GROUP BY ALL) AS b USING (year)""",
        "year, ours, published, diff, ok",
        "",
        POP + UNITS,
    ),
)
def _(spark, d):
    year = F.year("o_orderdate")
    anchors = table(spark, d, "orders").groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("published")).withColumn("tolerance", F.when(F.col("year") == 1996, 100).otherwise(0))
    return cohort.anchor_check(crosswalked(spark, d), anchors)


@query(
    "cohort_group_quarters_by_sex",
    show(
        "SELECT coalesce(sex, 'total') AS sex, year, sum(gq_count)::BIGINT AS gq FROM unitpop GROUP BY GROUPING SETS ((year, sex), (year))",
        "year, sex, gq",
        "",
        POP + UNITS,
    ),
)
def _(spark, d):
    people = crosswalked(spark, d)
    return people.groupingSets([["year", "sex"], ["year"]], "year", "sex").agg(F.sum("gq_count").alias("gq")).select("year", F.coalesce("sex", F.lit("total")).alias("sex"), "gq")


@query(
    "cohort_explorer_pack",
    show(
        """SELECT g.unit, g.period, g.sex, to_json(flatten(list([coalesce(round(expected_t1)::BIGINT, 0), coalesce(count_t1::BIGINT, 0)] ORDER BY g.o))) AS pairs
  FROM (SELECT * FROM (SELECT DISTINCT unit, period, sex FROM flows) JOIN (SELECT DISTINCT period, cohort_age_at_t0, split_part(cohort_age_at_t0, '-', 1)::INT AS o FROM flows) USING (period)) AS g
  LEFT JOIN flows f ON f.unit = g.unit AND f.period = g.period AND f.sex = g.sex AND f.cohort_age_at_t0 = g.cohort_age_at_t0 GROUP BY 1, 2, 3""",
        "unit, period, sex, pairs",
        "",
        POP + UNITS + FLOWS,
    ),
)
def _(spark, d):
    return cohort.pack(flows(spark, d)).withColumn("pairs", F.to_json("pairs"))

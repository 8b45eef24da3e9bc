"""Ledger queries: suppliers as units, ship years as fiscal years, line attributes as item codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions.stats import fisher_interval
from statloom.operators import ledger
from statloom.operators.ordered import exact_quantiles, shared
from statloom.plans.registry import query, show, to_cents
from statloom.plans.tables import cents, table

_LETTER = "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'E' WHEN 'AO' THEN 'F' WHEN 'NF' THEN 'G' WHEN 'NO' THEN 'L' WHEN 'RF' THEN 'I' ELSE 'X' END"
_FUNCTION = "CASE l_linenumber WHEN 1 THEN '62' WHEN 2 THEN '24' WHEN 3 THEN '12' WHEN 4 THEN '04' WHEN 5 THEN '32' WHEN 6 THEN '91' ELSE '01' END"

ITEMS = f"""
items AS (
  SELECT l_suppkey AS unit, year(l_shipdate) AS year, {_LETTER} || {_FUNCTION} AS code,
    (sum(round(l_extendedprice * 100)::BIGINT) // 100)::BIGINT AS amount,
    CASE WHEN max(l_tax) < 0.04 THEN 'I' WHEN max(l_tax) < 0.06 THEN 'A' ELSE 'R' END AS flag
  FROM lineitem GROUP BY 1, 2, 3),
directory AS (
  SELECT l_suppkey AS unit, year(l_shipdate) AS year, sum(l_quantity)::BIGINT * 50 AS pop, any_value(s_name) AS name, any_value(n_name) AS state,
    any_value(s_acctbal) AS acctbal
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2),
"""


def items(spark, d):
    return shared(_items(spark, d))


def _items(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_linenumber", "l_extendedprice", "l_tax")
    code = F.concat(F.expr(_LETTER), F.expr(_FUNCTION))
    tax = F.max("l_tax")
    return lines.groupBy(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("year"), code.alias("code")).agg(
        F.floor(F.sum(cents("l_extendedprice")) / 100).alias("amount"),
        F.when(tax < 0.04, "I").when(tax < 0.06, "A").otherwise("R").alias("flag"),
    )


def directory(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("year")).agg(
        (F.sum("l_quantity").cast("bigint") * 50).alias("pop")
    )
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    places = places.select(F.col("s_suppkey").alias("unit"), F.col("s_name").alias("name"), F.col("n_name").alias("state"), F.col("s_acctbal").alias("acctbal"))
    return shared(lines.join(places, "unit"))


def metrics(spark, d):
    return shared(ledger.ledger_metrics(items(spark, d)))


def _sum(cond):
    return f"coalesce(sum(CASE WHEN {cond} THEN amount END), 0)::BIGINT * 1000"


_EXP = "substr(code,1,1) IN ('E','F','G','I','J','L','M','Q','S')"
_GEN = _EXP + " AND substr(code,2,2) NOT IN ('90','91','92','93','94')"
_EFG = "substr(code,1,1) IN ('E','F','G')"
_LMQS = "substr(code,1,1) IN ('L','M','Q','S')"
_SHARES = ", ".join(
    f"CASE WHEN {base} <> 0 AND record_complete THEN round_even({top} * 100 / {base}, 2) END AS {t}_pct_{b}"
    for t, top in (("police", "police_usd"), ("fire", "fire_usd"), ("police_fire", "(police_usd + fire_usd)"))
    for b, base in (
        ("general", "general_expenditure_usd"),
        ("total", "total_expenditure_usd"),
        ("general_ex_edu", "general_ex_education_usd"),
        ("core", "core_municipal_expenditure_usd"),
    )
)

METRICS = (
    ITEMS
    + f"""
m0 AS (SELECT unit, year, {_sum(_EXP)} AS total_expenditure_usd, {_sum(_GEN)} AS general_expenditure_usd,
  {_sum("substr(code,1,1) IN ('E','F','G','I','J') AND substr(code,2,2) NOT IN ('90','91','92','93','94')")} AS direct_general_expenditure_usd,
  {_sum(_EXP + " AND substr(code,2,2) IN ('09','12','16','18','21')")} AS education_usd,
  {_sum(_EXP + " AND substr(code,2,2) IN ('04','05','36','77','79')")} AS county_like_functions_usd,
  {_sum(_EXP + " AND substr(code,2,2) IN ('01','87')")} AS enterprise_usd, {_sum(_EXP + " AND substr(code,2,2) = '32'")} AS health_usd,
  {_sum(_EFG + " AND substr(code,2,2) = '62'")} AS police_usd, {_sum("code = 'E62'")} AS police_current_ops_usd,
  {_sum("code IN ('F62','G62')")} AS police_capital_usd, {_sum(_LMQS + " AND substr(code,2,2) = '62'")} AS police_intergov_usd,
  {_sum(_EFG + " AND substr(code,2,2) = '24'")} AS fire_usd, {_sum("code = 'E24'")} AS fire_current_ops_usd,
  {_sum("code IN ('F24','G24')")} AS fire_capital_usd, {_sum(_LMQS + " AND substr(code,2,2) = '24'")} AS fire_intergov_usd,
  coalesce(string_agg(DISTINCT CASE WHEN {_EFG} AND substr(code,2,2) = '62' AND amount <> 0 THEN flag END, '' ORDER BY CASE WHEN {_EFG} AND substr(code,2,2) = '62' AND amount <> 0 THEN flag END), '-') AS police_flags,
  coalesce(string_agg(DISTINCT CASE WHEN {_EFG} AND substr(code,2,2) = '24' AND amount <> 0 THEN flag END, '' ORDER BY CASE WHEN {_EFG} AND substr(code,2,2) = '24' AND amount <> 0 THEN flag END), '-') AS fire_flags,
  round_even(sum(CASE WHEN {_EXP} AND flag = 'I' THEN amount ELSE 0 END) / sum(CASE WHEN {_EXP} THEN amount END), 3) AS unit_imputed_share,
  count(*) AS n_items FROM items GROUP BY 1, 2),
m1 AS (SELECT *, general_expenditure_usd - education_usd AS general_ex_education_usd,
  general_expenditure_usd - education_usd - county_like_functions_usd - health_usd - enterprise_usd AS core_municipal_expenditure_usd,
  police_usd > 0 AND n_items >= 30 AND general_expenditure_usd > 0 AS record_complete FROM m0),
metrics AS (SELECT *, {_SHARES} FROM m1),
"""
)

_LONGS = (
    "total_expenditure_usd, general_expenditure_usd, direct_general_expenditure_usd, education_usd, county_like_functions_usd, enterprise_usd, health_usd, "
    "police_usd, police_current_ops_usd, police_capital_usd, police_intergov_usd, fire_usd, fire_current_ops_usd, fire_capital_usd, fire_intergov_usd, "
    "general_ex_education_usd, core_municipal_expenditure_usd"
)
_PCTS = ", ".join(f"{t}_pct_{b}" for t in ("police", "fire", "police_fire") for b in ("general", "total", "general_ex_edu", "core"))


@query(
    "ledger_metrics",
    show("SELECT * FROM metrics", "unit, year, n_items, record_complete, police_flags, fire_flags, " + _LONGS, "unit_imputed_share, " + _PCTS, METRICS),
)
def _(spark, d):
    return ledger.ledger_metrics(_items(spark, d))


@query(
    "ledger_universe_latest",
    show(
        """SELECT unit, arg_max(year, year) AS year, arg_max(pop, year) AS pop, any_value(name) AS name, any_value(state) AS state
  FROM directory WHERE unit IN (SELECT unit FROM directory GROUP BY 1 HAVING max(pop) >= 110000) GROUP BY 1""",
        "unit, year, pop, name, state",
        "",
        ITEMS,
    ),
)
def _(spark, d):
    rows = directory(spark, d)
    big = ledger.universe(rows, 110_000)
    return ledger.latest_record(rows.join(big, "unit", "left_semi")).select("unit", "year", "pop", "name", "state")


@query(
    "ledger_census_year",
    show(
        "SELECT m.unit, m.year, pop, police_usd, fire_usd FROM metrics m JOIN directory USING (unit, year) WHERE m.year = (SELECT max(year) FROM metrics WHERE year % 5 = 2)",
        "unit, year, pop, police_usd, fire_usd",
        "",
        METRICS,
    ),
)
def _(spark, d):
    rows = ledger.census_year_rows(metrics(spark, d)).join(directory(spark, d), ["unit", "year"])
    return rows.select("unit", "year", "pop", "police_usd", "fire_usd").orderBy(F.desc("pop"), "unit")


_CONS = [("SUPPLIER#00000000", "NATION_1"), ("SUPPLIER#00000001", "NATION_2"), ("SUPPLIER#00000005", "NATION_9")]
_CONS_SQL = " OR ".join(f"(state = '{s}' AND replace(upper(name), '-', ' ') LIKE '{p}%')" for p, s in _CONS)
FLAGS = (
    METRICS
    + f"""
issues AS (SELECT l_suppkey AS unit, year(l_shipdate) AS year, list_sort(list(CASE WHEN l_tax = 0.08 THEN 'verified issue: ' ELSE 'possible issue: ' END || 'order ' || l_orderkey)) AS found
  FROM lineitem WHERE l_discount = 0.1 AND l_quantity = 50 GROUP BY 1, 2),
fl AS (SELECT *, education_usd * 100.0 / g > 5 AS runs_schools, county_like_functions_usd * 100.0 / g > 3 AS county_like,
    fire_usd = 0 AND record_complete AS fire_external,
    police_intergov_usd > police_usd OR (record_complete AND coalesce(police_pct_core, 100) < 5) AS police_contracted
  FROM (SELECT m.*, CASE WHEN general_expenditure_usd = 0 THEN 1 ELSE general_expenditure_usd END AS g, state = 'VA' OR {_CONS_SQL} AS consolidated,
        found FROM metrics m JOIN directory USING (unit, year) LEFT JOIN issues USING (unit, year)) AS q),
"""
)


NOTE = """array_to_string(list_concat(list_filter([
  CASE WHEN consolidated THEN 'consolidated or independent city: carries county functions' END,
  CASE WHEN runs_schools THEN 'school system inside city books' END,
  CASE WHEN county_like AND NOT consolidated THEN 'county functions above 3% of general expenditure' END,
  CASE WHEN police_flags NOT IN ('R', '-') OR fire_flags NOT IN ('R', '-') THEN 'police or fire contains imputed or adjusted items' END,
  CASE WHEN coalesce(unit_imputed_share, 0) > 0.5 THEN 'majority of expenditure imputed' END,
  CASE WHEN NOT record_complete THEN 'incomplete record: shares null' END,
  CASE WHEN fire_external THEN 'no fire spending: provided by another government' END,
  CASE WHEN police_contracted THEN 'police likely contracted' END,
  CASE WHEN fire_intergov_usd > fire_usd THEN 'fire provided by contract' END], lambda x: x IS NOT NULL), coalesce(found, [])), '; ')"""


@query(
    "ledger_comparability_notes",
    show(
        f"SELECT unit, year, consolidated, runs_schools, county_like, fire_external, police_contracted, {NOTE} AS note FROM fl",
        "unit, year, consolidated, runs_schools, county_like, fire_external, police_contracted, note",
        "",
        FLAGS,
    ),
)
def _(spark, d):
    return flags(spark, d)


def flags(spark, d, listed=True):
    """Flags and notes, the notes with the issues of the record if ``listed``."""
    issues = table(spark, d, "lineitem").filter("l_discount = 0.1 AND l_quantity = 50").select(
        F.col("l_suppkey").alias("unit"),
        F.year("l_shipdate").alias("year"),
        F.when(F.col("l_tax") == 0.08, "verified").otherwise("possible").alias("status"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(". see books")).alias("finding"),
    )
    rows = metrics(spark, d).join(directory(spark, d).select("unit", "year", "name", "state"), ["unit", "year"])
    out = ledger.comparability(rows, issues if listed else None, ledger.is_consolidated("name", "state", _CONS))
    return out.select("unit", "year", "consolidated", "runs_schools", "county_like", "fire_external", "police_contracted", "note")


STAFF = """
staff AS (
  SELECT l_suppkey AS unit, year(l_shipdate) AS year, CASE l_linenumber WHEN 1 THEN '000' WHEN 2 THEN '062' WHEN 3 THEN '162' WHEN 4 THEN '024' WHEN 5 THEN '124' ELSE '999' END AS code,
    sum(l_quantity)::BIGINT AS ft, (sum(round(l_extendedprice * 100)::BIGINT) // 100)::BIGINT AS ft_pay,
    CASE max(l_returnflag) WHEN 'R' THEN CASE WHEN min(l_returnflag) = 'R' THEN 'R' WHEN min(l_returnflag) = 'N' THEN 'I' ELSE 'T' END WHEN 'A' THEN 'K' ELSE ' ' END AS ft_flag
  FROM lineitem GROUP BY 1, 2, 3),
"""


def staff(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    code = F.expr("CASE l_linenumber WHEN 1 THEN '000' WHEN 2 THEN '062' WHEN 3 THEN '162' WHEN 4 THEN '024' WHEN 5 THEN '124' ELSE '999' END")
    lo, hi = F.min("l_returnflag"), F.max("l_returnflag")
    return lines.groupBy(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("year"), code.alias("code")).agg(
        F.sum("l_quantity").cast("bigint").alias("ft"),
        F.floor(F.sum(cents("l_extendedprice")) / 100).alias("ft_pay"),
        F.when(hi == "R", F.when(lo == "R", "R").when(lo == "N", "I").otherwise("T")).when(hi == "A", "K").otherwise(" ").alias("ft_flag"),
    )


def _emp(code, m):
    return f"coalesce(sum(CASE WHEN code = '{code}' THEN {m} END), 0)::BIGINT"


_EMP_COLS = ", ".join(f"{_emp(c, m)} AS {n}_{m}" for c, n in ledger.EMPLOYMENT_CODES.items() for m in ("ft", "ft_pay"))


def _cls(codes):
    seen = f"list_filter(list(DISTINCT CASE WHEN code IN {codes} THEN ft_flag END), lambda f: f IS NOT NULL AND trim(f) <> '')"
    return (
        f"CASE WHEN len({seen}) = 0 THEN '' WHEN len(list_filter({seen}, lambda f: f NOT IN ('R','C','K','U','V','Z'))) = 0 THEN 'reported' "
        f"WHEN len(list_filter({seen}, lambda f: f NOT IN ('R','C','K','U','V','Z','T'))) = 0 THEN 'prorated' ELSE 'imputed' END"
    )


EMPLOYMENT = (
    ITEMS
    + STAFF
    + f"""
e0 AS (SELECT unit, year, {_EMP_COLS}, {_cls("('062','162')")} AS police_flag_class, {_cls("('024','124')")} AS fire_flag_class
  FROM staff WHERE code <> '999' GROUP BY 1, 2),
emp AS (SELECT e0.*, pop, CASE WHEN pop <> 0 THEN police_sworn_ft * 1000 / pop END AS sworn_per_1k,
  CASE WHEN pop <> 0 THEN fire_firefighters_ft * 1000 / pop END AS firefighters_per_1k,
  CASE WHEN police_sworn_ft + police_other_ft <> 0 THEN police_other_ft / (police_sworn_ft + police_other_ft) END AS police_civilian_share,
  CASE WHEN total_ft <> 0 THEN (police_sworn_ft + police_other_ft + fire_firefighters_ft + fire_other_ft) / total_ft END AS police_fire_share_of_city_ft,
  CASE WHEN police_sworn_ft <> 0 THEN police_sworn_ft_pay * 12 / police_sworn_ft END AS sworn_pay_annualised,
  CASE WHEN fire_firefighters_ft <> 0 THEN fire_firefighters_ft_pay * 12 / fire_firefighters_ft END AS firefighter_pay_annualised
  FROM e0 LEFT JOIN directory USING (unit, year)),
"""
)


@query(
    "employment_metrics",
    show(
        "SELECT * FROM emp",
        "unit, year, pop, police_flag_class, fire_flag_class, " + ", ".join(f"{n}_{m}" for n in ledger.EMPLOYMENT_CODES.values() for m in ("ft", "ft_pay")),
        "sworn_per_1k, firefighters_per_1k, police_civilian_share, police_fire_share_of_city_ft, sworn_pay_annualised, firefighter_pay_annualised",
        EMPLOYMENT,
    ),
)
def _(spark, d):
    return ledger.employment_metrics(staff(spark, d), directory(spark, d).select("unit", "year", "pop"))


INDEX = """
monthly AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, sum(round(o_totalprice * 100)::BIGINT) / 100.0 / count(*) AS value FROM orders GROUP BY 1, 2),
published AS (SELECT year(o_orderdate) AS year, sum(round(o_totalprice * 100)::BIGINT) / 100.0 / count(*) AS value FROM orders WHERE year(o_orderdate) IN (1996, 1998) GROUP BY 1),
cpi AS (SELECT coalesce(p.year, a.year) AS year, coalesce(p.value, a.v) AS value, CASE WHEN p.value IS NOT NULL THEN 'published' ELSE 'mean of 12' END AS basis
  FROM (SELECT year, avg(value) AS v FROM monthly GROUP BY 1 HAVING count(*) = 12) AS a FULL JOIN published p ON p.year = a.year),
"""


def price_index(spark, d):
    orders = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice")
    mean = (F.sum(cents("o_totalprice")) / 100.0 / F.count(F.lit(1))).alias("value")
    monthly = orders.groupBy("year", "month").agg(mean)
    published = orders.filter(F.col("year").isin(1996, 1998)).groupBy("year").agg(mean)
    return ledger.annual_average(monthly, published), monthly


@query("annual_index", show("SELECT * FROM cpi", "year, basis", "value", INDEX))
def _(spark, d):
    return price_index(spark, d)[0]


@query(
    "annual_index_two_source_check",
    show(
        "SELECT max(abs(p.value - a.v)) AS worst, count(*) AS n_years FROM published p JOIN (SELECT year, avg(value) AS v FROM monthly GROUP BY 1 HAVING count(*) = 12) AS a USING (year)",
        "n_years",
        "worst",
        INDEX,
    ),
)
def _(spark, d):
    index, monthly = price_index(spark, d)
    means = monthly.groupBy("year").agg(F.avg("value").alias("v"), F.count("value").alias("n")).filter("n = 12")
    both = index.filter("basis = 'published'").join(means, "year")
    return both.agg(F.max(F.abs(F.col("value") - F.col("v"))).alias("worst"), F.count(F.lit(1)).alias("n_years"))


RPP = "rpp AS (SELECT state AS area, year, 100 * avg(pop) / any_value(nat) AS rpp FROM (SELECT *, avg(pop) OVER (PARTITION BY year) AS nat FROM directory) GROUP BY 1, 2),"


@query(
    "deflated_spending",
    show(
        """SELECT m.unit, m.year, m.police_usd * b.base / p.value AS real, m.police_usd * b.base / coalesce(p.value, s.value) AS real_fallback,
  m.police_usd * b.base / p.value / (r.rpp / 100) AS regional_real
  FROM metrics m JOIN directory USING (unit, year) CROSS JOIN (SELECT arg_max(value, year) AS base FROM cpi) AS b
  LEFT JOIN cpi p ON p.year = m.year - 1 LEFT JOIN cpi s ON s.year = m.year LEFT JOIN rpp r ON r.area = state AND r.year = m.year - 1""",
        "unit, year",
        "",
        METRICS + INDEX + RPP,
        "real, real_fallback, regional_real",
    ),
)
def _(spark, d):
    index, _ = price_index(spark, d)
    places = directory(spark, d)
    nation = places.groupBy("year").agg(F.avg("pop").alias("nat"))
    parity = places.groupBy(F.col("state").alias("area"), "year").agg(F.avg("pop").alias("mean")).join(nation, "year").select("area", "year", (F.col("mean") * 100 / F.col("nat")).alias("rpp"))
    rows = metrics(spark, d).select("unit", "year", "police_usd").join(places.select("unit", "year", "state"), ["unit", "year"])
    rows = ledger.deflate(rows, index, "year", "police_usd")
    rows = ledger.deflate(rows, index, "year", "police_usd", fallback=True, name="real_fallback")
    rows = ledger.regional_deflate(rows, parity, "state", "year", "real").select("unit", "year", "real", "real_fallback", "regional_real")
    return to_cents(rows, "real", "real_fallback", "regional_real")


# a second index: what a unit of the suppliers' goods costs them
COSTS = """
costs AS (SELECT year(l_shipdate) AS year, sum(round(l_extendedprice * 100)::BIGINT) / 100.0 / sum(l_quantity) AS value FROM lineitem GROUP BY 1),
"""


@query(
    "redeflated_trend",
    show(
        """SELECT year, n, med AS median, med / arg_min(med, year) OVER () AS ratio FROM (SELECT year, count(*) AS n, median(nominal * base / coalesce(b.value, o.value)) AS med FROM (
   SELECT year, (police_usd + fire_usd) * 1.0 / pop AS nominal FROM metrics JOIN directory USING (unit, year) WHERE pop > 0) AS r CROSS JOIN (SELECT value AS base FROM costs WHERE year = 1998) AS z
   LEFT JOIN (SELECT year + 1 AS year, value FROM costs) AS b USING (year) LEFT JOIN costs o USING (year) GROUP BY 1) AS t""",
        "year, n",
        "median, ratio",
        METRICS + COSTS,
    ),
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), "l_extendedprice", "l_quantity")
    index = lines.groupBy("year").agg((F.sum(cents("l_extendedprice")) / 100.0 / F.sum("l_quantity")).alias("value"))
    rows = metrics(spark, d).select("unit", "year", "police_usd", "fire_usd").join(directory(spark, d).select("unit", "year", "pop").filter("pop > 0"), ["unit", "year"])
    return ledger.redeflated_trend(rows.withColumn("nominal", (F.col("police_usd") + F.col("fire_usd")) / F.col("pop")), index, "nominal", 1998)


@query(
    "undo_real_per_capita",
    show(
        "SELECT unit, year, (police_usd + fire_usd) / value * pop AS nominal_total FROM metrics JOIN directory USING (unit, year) JOIN cpi USING (year)",
        "unit, year",
        ctes=METRICS + INDEX,
        money="nominal_total",
    ),
)
def _(spark, d):
    index, _ = price_index(spark, d)
    # the operator is given figures that are not its own inverse, and a yearly row of all units together
    figure = (F.col("police_usd") + F.col("fire_usd")).alias("real_per_head")
    units = metrics(spark, d).select("unit", "year", figure).join(directory(spark, d).select("unit", "year", "pop"), ["unit", "year"])
    whole = units.groupBy("year").agg(F.avg("real_per_head").alias("real_per_head"), F.sum("pop").alias("pop"))
    rows = units.unionByName(whole, allowMissingColumns=True).join(index, "year")
    return to_cents(ledger.undo_real_per_capita(rows, "real_per_head", "value", "pop").select("unit", "year", "nominal_total"), "nominal_total")


COUNTY = """
trips AS (SELECT l_suppkey AS place, c_nationkey AS county, l_linenumber AS ln, round(l_extendedprice * 100)::BIGINT AS cents
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
parts AS (SELECT place, county, count(*) AS part_pop FROM trips GROUP BY 1, 2),
counties AS (SELECT county, count(*) AS pop, sum(CASE WHEN ln = 1 THEN cents ELSE 0 END) / 100.0 AS corr, sum(CASE WHEN ln = 2 THEN cents ELSE 0 END) / 100.0 AS jud,
  sum(CASE WHEN ln = 3 THEN cents ELSE 0 END) / 100.0 AS pol FROM trips JOIN nation ON n_nationkey = county WHERE n_regionkey <> 2 GROUP BY 1),
"""
ALLOCATION = """SELECT o.unit AS place, coalesce(a.corr, 0) AS county_corr_alloc, coalesce(a.jud, 0) AS county_jud_alloc, CASE WHEN o.contracted THEN coalesce(a.pol, 0) END AS county_pol_alloc,
  coalesce(a.n, 0) AS n_counties, a.n IS NOT NULL AS has_county_government,
  o.own + coalesce(a.corr, 0) + coalesce(a.jud, 0) + CASE WHEN o.contracted THEN coalesce(a.pol, 0) ELSE 0 END AS total
  FROM (SELECT unit, sum(police_usd + fire_usd) AS own, any_value(s_acctbal) < 1000 AS contracted FROM metrics JOIN supplier ON s_suppkey = unit GROUP BY 1) AS o
  LEFT JOIN (SELECT place, sum(corr * least(part_pop / pop, 1)) AS corr, sum(jud * least(part_pop / pop, 1)) AS jud, sum(pol * least(part_pop / pop, 1)) AS pol, count(*) AS n
    FROM parts JOIN counties USING (county) GROUP BY 1) AS a ON a.place = o.unit"""


@query(
    "county_spending_allocation",
    show(
        ALLOCATION,
        "place, n_counties, has_county_government",
        "",
        METRICS + COUNTY,
        "county_corr_alloc, county_jud_alloc, county_pol_alloc, total",
    ),
)
def _(spark, d):
    return to_cents(allocation(spark, d), "county_corr_alloc", "county_jud_alloc", "county_pol_alloc", "total")


def allocation(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("place"), "l_linenumber", cents("l_extendedprice").alias("cents"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    people = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("county"))
    cells = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("place", "county", "l_linenumber")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    )
    cells = shared(cells)
    parts = cells.groupBy("place", "county").agg(F.sum("n").alias("part_pop"))
    governed = table(spark, d, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("county"))
    spent = lambda k: (F.sum(F.when(F.col("l_linenumber") == k, F.col("cents")).otherwise(0)) / 100.0)
    counties = cells.groupBy("county").agg(F.sum("n").alias("pop"), spent(1).alias("corr"), spent(2).alias("jud"), spent(3).alias("pol")).join(governed, "county", "left_semi")
    own = metrics(spark, d).groupBy(F.col("unit").alias("place")).agg(F.sum(F.col("police_usd") + F.col("fire_usd")).alias("own_usd"))
    places = table(spark, d, "supplier").select(F.col("s_suppkey").alias("place"), (F.col("s_acctbal") < 1000).alias("contracted"))
    return ledger.allocate_county_spending(parts, counties, own.join(places, "place"))


CRIME = (
    ITEMS
    + """
feed AS (SELECT l_suppkey AS unit, year(l_shipdate) AS year, count(DISTINCT month(l_shipdate)) AS months,
  (count(*) FILTER (WHERE l_returnflag = 'R'))::BIGINT AS violent, (count(*) FILTER (WHERE l_returnflag = 'A') * 40)::BIGINT AS property, sum(l_quantity)::BIGINT * 50 AS q
  FROM lineitem GROUP BY 1, 2),
grid AS (SELECT unit, year, CASE WHEN acctbal > 9000 THEN NULL ELSE pop END AS pop, acctbal FROM directory),
gridpop AS (SELECT g.unit, g.year, g.acctbal, coalesce(g.pop, a.pop, b.pop, 100000)::BIGINT AS census_pop FROM grid g
  LEFT JOIN grid a ON a.unit = g.unit AND a.year = g.year - 1 LEFT JOIN grid b ON b.unit = g.unit AND b.year = g.year + 1),
cr AS (SELECT g.unit, g.year, census_pop, CASE WHEN acctbal >= 1000 THEN months END AS months, CASE WHEN acctbal >= 0 THEN violent END AS violent, CASE WHEN acctbal >= 0 THEN property END AS property,
  CASE WHEN acctbal < 8000 THEN q ELSE q * 2 END AS covered_pop FROM gridpop g JOIN feed f ON f.unit = g.unit AND f.year = g.year),
cov AS (SELECT *, covered_pop * 1.0 / census_pop AS ratio, CASE WHEN violent IS NULL AND property IS NULL THEN 'missing'
   WHEN covered_pop * 1.0 / census_pop > 1.5 OR covered_pop * 1.0 / census_pop < 0.67 THEN 'not_city' WHEN months IS NULL THEN 'unknown' WHEN months >= 12 THEN 'full' ELSE 'partial' END AS coverage FROM cr),
"""
)


def crime(spark, d):
    feed = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("year")).agg(
        F.count_distinct(F.month("l_shipdate")).alias("_months"),
        F.count_if(F.col("l_returnflag") == "R").alias("_violent"),
        (F.count_if(F.col("l_returnflag") == "A") * 40).alias("_property"),
    )
    grid = directory(spark, d).withColumn("_pop", F.when(F.col("acctbal") <= 9000, F.col("pop")))
    grid = ledger.neighbour_year(grid, "unit", "year", "_pop", F.lit(100000), "census_pop")
    joined = grid.join(feed, ["unit", "year"], "left").select(
        "unit",
        "year",
        F.col("census_pop").cast("bigint").alias("census_pop"),
        F.when(F.col("acctbal") < 8000, F.col("pop")).otherwise(F.col("pop") * 2).alias("covered_pop"),
        F.when(F.col("acctbal") >= 1000, F.col("_months")).alias("months"),
        F.when(F.col("acctbal") >= 0, F.col("_violent")).alias("violent"),
        F.when(F.col("acctbal") >= 0, F.col("_property")).alias("property"),
        F.col("_months").isNotNull().alias("found"),
    )
    return ledger.crime_coverage(joined)


@query(
    "crime_coverage",
    show(
        """SELECT unit, year, census_pop, coverage, months, violent, property, CASE WHEN coverage <> 'missing' THEN ratio END AS population_ratio,
  CASE WHEN coverage IN ('full', 'unknown') THEN violent * 1000 / census_pop END AS violent_per_1k, CASE WHEN coverage IN ('full', 'unknown') THEN property * 1000 / census_pop END AS property_per_1k FROM cov""",
        "unit, year, census_pop, coverage, months, violent, property",
        "population_ratio, violent_per_1k, property_per_1k",
        CRIME,
    ),
)
def _(spark, d):
    return crime(spark, d).drop("found", "covered_pop")


@query(
    "crime_consistency_breaks",
    show(
        """SELECT c.unit, c.year, c.coverage, CASE WHEN c.year >= 2000 AND c.violent IS NOT NULL AND mv >= 10 THEN CASE
   WHEN c.violent < 0.6 * mv OR (mp >= 600 AND c.property < 0.5 * mp) THEN 'break_low' WHEN c.violent > 1.8 * mv OR (mp >= 600 AND c.property > 2 * mp) THEN 'break_high' ELSE '' END ELSE '' END AS consistency
  FROM cov c LEFT JOIN (SELECT unit, median(violent) AS mv, median(property) AS mp FROM cov WHERE coverage = 'full' AND violent IS NOT NULL AND year BETWEEN 1995 AND 1999
    GROUP BY 1 HAVING count(*) >= 3) AS b ON b.unit = c.unit""",
        "unit, year, coverage, consistency",
        "",
        CRIME,
    ),
)
def _(spark, d):
    out = ledger.break_flag(crime(spark, d), (1995, 1999), 2000, 3, 10, 600)
    return out.select("unit", "year", "coverage", "consistency")


@query(
    "crime_coverage_counts",
    show(
        "SELECT year, count(*) FILTER (WHERE coverage = 'full') AS full_n, count(*) FILTER (WHERE coverage = 'partial') AS partial_n, count(*) FILTER (WHERE coverage = 'missing') AS missing_n, count(*) AS n FROM cov GROUP BY 1",
        "year, full_n, partial_n, missing_n, n",
        "",
        CRIME,
    ),
)
def _(spark, d):
    c = F.col("coverage")
    return crime(spark, d).groupBy("year").agg(
        F.count_if(c == "full").alias("full_n"), F.count_if(c == "partial").alias("partial_n"), F.count_if(c == "missing").alias("missing_n"), F.count(F.lit(1)).alias("n")
    )


PANEL = (
    METRICS
    + INDEX
    + """
rows0 AS (SELECT m.unit, m.year, police_fire_pct_general AS share, (police_usd + fire_usd) * (SELECT arg_max(value, year) FROM cpi) / c.value / pop AS per_resident, state, pop, record_complete
  FROM metrics m JOIN directory USING (unit, year) LEFT JOIN cpi c ON c.year = m.year - 1),
panel AS (SELECT unit FROM rows0 WHERE year IN (1996, 1998, 2000) AND share IS NOT NULL AND per_resident IS NOT NULL GROUP BY 1 HAVING count(DISTINCT year) = 3),
"""
)


def panel_rows(spark, d):
    index, _ = price_index(spark, d)
    places = directory(spark, d).select("unit", "year", "pop", "state")
    rows = metrics(spark, d).join(places, ["unit", "year"]).withColumn("both", F.col("police_usd") + F.col("fire_usd"))
    real = ledger.deflate(rows, index, "year", "both")
    rows = shared(
        real.select("unit", "year", F.col("police_fire_pct_general").alias("share"), (F.col("real") / F.col("pop")).alias("per_resident"), "state", "pop", "record_complete")
    )
    panel = ledger.balanced_panel(rows, "unit", "year", [1996, 1998, 2000], F.col("share").isNotNull() & F.col("per_resident").isNotNull())
    return rows, panel


@query(
    "balanced_panel_trend",
    show(
        """SELECT year, median(share) AS share_median, median(per_resident) AS per_resident_median, greatest(count(share), count(per_resident)) AS n
  FROM rows0 WHERE unit IN (SELECT unit FROM panel) GROUP BY 1 HAVING n > 0.8 * (SELECT count(*) FROM panel)""",
        "year, n",
        "share_median, per_resident_median",
        PANEL,
    ),
)
def _(spark, d):
    rows, panel = panel_rows(spark, d)
    return ledger.panel_series(rows, panel, "unit", "year", ["share", "per_resident"])


@query(
    "panel_composition",
    show(
        """SELECT unit IN (SELECT unit FROM panel) AS inside, count(*) AS n, 100 * avg(CASE WHEN state IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_7') THEN 1.0 ELSE 0 END) AS in_set_pct,
  median(pop) AS pop_median, median(share) AS share_median FROM rows0 WHERE year = 2000 GROUP BY 1""",
        "inside, n",
        "in_set_pct, pop_median, share_median",
        PANEL,
    ),
)
def _(spark, d):
    rows, panel = panel_rows(spark, d)
    year = rows.filter("year = 2000").withColumn("pop", F.col("pop").cast("double"))
    return ledger.composition(year, panel, "unit", F.col("state").isin("NATION_1", "NATION_2", "NATION_3", "NATION_7"), ["pop", "share"])


def _excl(p):
    return f"""(SELECT list_extract(v, j::INT) * (1 - (h - j)) + list_extract(v, j::INT + 1) * (h - j) FROM (SELECT h, greatest(1, least(floor(h), n - 1)) AS j FROM (SELECT {p} * (n + 1) AS h)))"""


@query(
    "share_deciles_exclusive",
    show(
        f"""SELECT year, n, {_excl(0.1)} AS d1, {_excl(0.25)} AS q1, {_excl(0.5)} AS q2, {_excl(0.75)} AS q3, {_excl(0.9)} AS d9
  FROM (SELECT year, count(share) AS n, list(share ORDER BY share) FILTER (WHERE share IS NOT NULL) AS v FROM rows0 GROUP BY 1 HAVING count(share) > 1) AS t""",
        "year, n",
        "d1, q1, q2, q3, d9",
        PANEL,
    ),
)
def _(spark, d):
    # the share alone: nothing else of the panel is read
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"))
    rows = ledger.ledger_metrics(_items(spark, d)).select("unit", "year", F.col("police_fire_pct_general").alias("share")).join(known, "unit", "left_semi")
    out = exact_quantiles(shared(rows), "year", "share", {"d1": 0.1, "q1": 0.25, "q2": 0.5, "q3": 0.75, "d9": 0.9}, "exclusive")
    return out.filter("n > 1")


@query(
    "share_correlations",
    show(
        """SELECT year, CASE WHEN n > 30 THEN r END AS size_share, n AS size_share_n, CASE WHEN n > 30 AND abs(r) < 1 THEN tanh(atanh(r) - 1.96 / sqrt(n - 3)) END AS lo,
  CASE WHEN n > 30 AND abs(r) < 1 THEN tanh(atanh(r) + 1.96 / sqrt(n - 3)) END AS hi FROM (
  SELECT year, corr(log10(pop), share) AS r, count(*) FILTER (WHERE share IS NOT NULL) AS n FROM rows0 GROUP BY 1) AS t""",
        "year, size_share_n",
        "size_share, lo, hi",
        PANEL,
    ),
)
def _(spark, d):
    rows, _ = panel_rows(spark, d)
    out = ledger.guarded_corr(rows.withColumn("size", F.log10("pop")), ["year"], [("size_share", "size", "share")], 30)
    ci = fisher_interval("size_share", "size_share_n")
    return out.withColumn("lo", ci["lo"]).withColumn("hi", ci["hi"])


@query(
    "crime_quartiles",
    show(
        """SELECT quartile, min(violent_per_1k) AS low, max(violent_per_1k) AS high, count(*) AS size, median(property_per_1k) AS property_per_1k_median FROM (
  SELECT *, least((row_number() OVER (ORDER BY violent_per_1k, uy) - 1) // (count(*) OVER () // 4), 3) + 1 AS quartile FROM (
    SELECT unit * 10000 + year AS uy, violent * 1000 / census_pop AS violent_per_1k, property * 1000 / census_pop AS property_per_1k FROM cov WHERE coverage IN ('full', 'unknown')) AS a) AS b GROUP BY 1""",
        "quartile, size",
        "low, high, property_per_1k_median",
        CRIME,
    ),
)
def _(spark, d):
    rows = crime(spark, d).filter(F.col("violent_per_1k").isNotNull()).withColumn("uy", F.col("unit") * 10000 + F.col("year"))
    return ledger.quartile_table(rows, "violent_per_1k", "uy", ["property_per_1k"])


@query(
    "state_share_medians",
    show("SELECT state, median(share) AS median, count(share) AS n FROM rows0 GROUP BY 1 HAVING count(share) >= 6", "state, n", "median", PANEL),
)
def _(spark, d):
    rows, _ = panel_rows(spark, d)
    return ledger.group_medians(rows, "state", "share").orderBy(F.desc("median"), "state")


@query(
    "yoy_anomalies",
    show(
        """SELECT unit, year, prev_year, police_usd, prev, (police_usd - prev) * 1.0 / prev AS change FROM (
  SELECT unit, year, police_usd, lag(year) OVER w AS prev_year, lag(police_usd) OVER w AS prev FROM metrics WINDOW w AS (PARTITION BY unit ORDER BY year)) AS t
  WHERE prev > 0 AND abs((police_usd - prev) * 1.0 / prev) > 0.4""",
        "unit, year, prev_year, police_usd, prev",
        "change",
        METRICS,
    ),
)
def _(spark, d):
    out = ledger.yoy_anomaly(metrics(spark, d).select("unit", "year", "police_usd"), "unit", "year", "police_usd")
    return out.select("unit", "year", "prev_year", "police_usd", "prev", "change")


@query(
    "share_band_histogram",
    show(
        "SELECT least(floor(share / 2.5), 23)::BIGINT AS band, count(*) AS n FROM rows0 WHERE share IS NOT NULL GROUP BY 1",
        "band, n",
        "",
        PANEL,
    ),
)
def _(spark, d):
    rows, _ = panel_rows(spark, d)
    return rows.filter(F.col("share").isNotNull()).groupBy(F.least(F.floor(F.col("share") / 2.5), F.lit(23)).cast("bigint").alias("band")).agg(F.count(F.lit(1)).alias("n"))

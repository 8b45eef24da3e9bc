"""Published tables to tidy rows: padded text, wide sheets, chunked downloads, nested JSON, RSS, HTML tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.functions.text import first_match, lenient_number
from statloom.operators.cohort import recode


def read_padded_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, headers and cells trimmed."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote="")
    return trim_all(raw)


def trim_all(df: DataFrame) -> DataFrame:
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns])


def wide_to_tidy(wide: DataFrame, ids: list[str], variables: DataFrame, value: str = "count") -> DataFrame:
    """Variable columns to rows through a map variables(var, sex, age_bin), summed per cell; unmapped columns drop out."""
    columns = [c for c in wide.columns if c not in ids]
    long = wide.select(*ids, *[F.col(c).cast("string") for c in columns]).unpivot(ids, columns, "var", "_v")
    return long.join(variables, "var").groupBy(*ids, "sex", "age_bin").agg(F.sum(F.col("_v").try_cast("bigint")).alias(value))


def merge_chunks(chunks: list[DataFrame], key: list[str]) -> DataFrame:
    """Column chunks of one table side by side; a cell missing from its chunk is '0'."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.join(c, key, "full_outer")
    return out.select(*key, *[F.coalesce(F.col(c), F.lit("0")).alias(c) for c in out.columns if c not in key])


def merge_segments(segments: list[DataFrame], level: str = "050", cells: int = 310) -> DataFrame:
    """Long segments(geo, level, race, sex, age, count) of one table, county rows only, summed over race.

    A geography that does not bring all its cells is reported with ``complete`` false.
    """
    rows = segments[0]
    for s in segments[1:]:
        rows = rows.unionByName(s)
    rows = rows.filter(F.col("level") == level)
    seen = rows.groupBy("geo").agg((F.count_distinct("race", "sex", "age") == cells).alias("complete"))
    return rows.groupBy("geo", "sex", "age").agg(F.sum("count").alias("count")).join(seen, "geo")


def clean_county_rows(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Second header dropped, long state and county codes cut, override table applied (an empty target drops the row).

    df(state, county, ...); overrides(geo, new_geo).  ``collision`` is true where two source units now share a code.
    """
    kept = df.filter(F.col("state").rlike(r"^\d+$"))
    geo = F.concat(F.substring("state", 1, 2), F.substring("county", 1, 3))
    raw = F.concat_ws("/", "state", "county")
    keyed = kept.withColumn("geo", geo).withColumn("_raw", raw).join(overrides, "geo", "left")
    moved = keyed.filter(F.col("new_geo").isNull() | (F.col("new_geo") != "")).withColumn("geo", F.coalesce("new_geo", "geo")).drop("new_geo")
    shared_code = moved.groupBy("geo").agg((F.count_distinct("_raw") > 1).alias("collision"))
    return moved.join(shared_code, "geo").drop("_raw")


def with_fallback_rows(rows: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of the fallback table for keys the main one lacks."""
    return rows.unionByName(fallback.join(rows.select(key).distinct(), key, "left_anti").select(*rows.columns))


def percent_sheet(wide: DataFrame, month: str, sources: list[str], low: float = 98.0, high: float = 102.0) -> DataFrame:
    """Percent distribution by source, non-numeric cells dropped, with a per-month check of the sum."""
    long = wide.select(month, *[F.col(c).cast("string") for c in sources]).unpivot([month], sources, "source", "_t")
    rows = long.withColumn("pct", F.col("_t").try_cast("double")).filter("pct IS NOT NULL").drop("_t")
    total = rows.groupBy(month).agg(F.sum("pct").between(low, high).alias("adds_up"))
    return rows.join(total, month)


def response_long(wide: DataFrame, month: str, columns: DataFrame) -> DataFrame:
    """Rate columns to (metric, unit, value): columns(column, metric, unit, scale)."""
    names = [c for c in wide.columns if c != month]
    long = wide.select(month, *[F.col(c).cast("double") for c in names]).unpivot([month], names, "column", "_v")
    return long.join(columns, "column").filter("_v IS NOT NULL").select(month, "metric", "unit", (F.col("_v") * F.col("scale")).alias("value"))


def mode_long(wide: DataFrame, month: str) -> DataFrame:
    """Collection-mode columns to rows with slugified mode names."""
    names = [c for c in wide.columns if c != month]
    long = wide.select(month, *[F.col(f"`{c}`").cast("double") for c in names]).unpivot([month], [F.col(f"`{c}`") for c in names], "mode", "value")
    return long.withColumn("mode", F.regexp_replace(F.lower("mode"), r"[^a-z0-9]+", "_")).filter("value IS NOT NULL")


def melt_months(wide: DataFrame, region: str, keep: Column, min_months: int = 60) -> DataFrame:
    """Date-named columns to (region, ym, value); too few month columns is an error."""
    months = [c for c in wide.columns if re.fullmatch(r"\d{4}-\d{2}(-\d{2})?", c)]
    if len(months) < min_months:
        raise ValueError(f"{len(months)} month columns, {min_months} wanted")
    rows = wide.filter(keep).select(region, *[F.col(f"`{c}`") for c in months])
    return rows.unpivot([region], [F.col(f"`{c}`") for c in months], "_d", "value").filter("value IS NOT NULL").select(region, F.substring("_d", 1, 7).alias("ym"), "value")


def latest_wins(parts: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Several files of one table; the row of the newest file per key."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def suppressed_wages(df: DataFrame, wage: str) -> DataFrame:
    """'-' and 0 are suppressed cells: NULL with ``disclosed`` false."""
    value = lenient_number(wage)
    return df.withColumn("disclosed", F.coalesce(value != 0, F.lit(False))).withColumn(wage, F.when(value != 0, value))


def nested_mix(docs: DataFrame, body: str) -> DataFrame:
    """data[day][stamp][fuel].gen documents to rows (day, stamp, fuel, gen)."""
    schema = "struct<data:map<string,map<string,map<string,struct<gen:double>>>>>"
    keep = [c for c in docs.columns if c != body]
    days = docs.select(*keep, F.explode(F.from_json(body, schema)["data"]).alias("day", "_s"))
    stamps = days.select(*keep, "day", F.explode("_s").alias("stamp", "_f"))
    fuels = stamps.select(*keep, "day", "stamp", F.explode("_f").alias("fuel", "_g"))
    return fuels.select(*keep, "day", "stamp", "fuel", F.col("_g.gen").alias("gen"))


def column_arrays(docs: DataFrame, body: str, wanted: list[str]) -> DataFrame:
    """{"fields": [...], "data": [[...]]} documents to one row per data row, cells picked by field name."""
    keep = [c for c in docs.columns if c != body]
    parsed = docs.select(*keep, F.from_json(body, "struct<fields:array<string>,data:array<array<string>>>").alias("_d"))
    rows = parsed.select(*keep, F.col("_d.fields").alias("_f"), F.explode("_d.data").alias("_r"))
    pick = lambda name: F.try_element_at("_r", F.array_position("_f", name).cast("int"))
    return rows.select(*keep, *[pick(w).alias(w) for w in wanted])


def parallel_arrays(docs: DataFrame, body: str, names: list[str]) -> DataFrame:
    """{"timestamp": [...], "close": [...]} documents to one row per position."""
    keep = [c for c in docs.columns if c != body]
    schema = "struct<" + ",".join(f"{n}:array<double>" for n in names) + ">"
    parsed = docs.select(*keep, F.from_json(body, schema).alias("_d"))
    zipped = parsed.select(*keep, F.explode(F.arrays_zip(*[F.col(f"_d.{n}").alias(n) for n in names])).alias("_z"))
    return zipped.select(*keep, *[F.col(f"_z.{n}").alias(n) for n in names])


def delimited(lines: DataFrame, schema: str, sep: str = "|", comment: str = "#") -> DataFrame:
    """Lines with a separator (or runs of blanks) to typed columns; comment and empty lines dropped."""
    rows = lines.filter(~F.trim("line").startswith(comment) & (F.trim("line") != ""))
    text = F.regexp_replace(F.trim("line"), r"\s+", ",") if sep == " " else F.col("line")
    return rows.select(F.from_csv(text, schema, {"sep": "," if sep == " " else sep}).alias("_c")).select("_c.*")


def feed_items(docs: DataFrame, body: str) -> DataFrame:
    """Items of RSS (``<item>``) and Atom (``<entry>``) documents: title, link, published, summary, item_id.

    A field is the first of its elements that is not empty, markers of literal text
    and the five named entities taken away; an Atom link is the ``href`` of its element.
    Missing fields are NULL.
    """
    keep = [c for c in docs.columns if c != body]
    items = docs.select(*keep, F.explode(F.regexp_extract_all(body, F.lit(r"(?s)(<(item|entry)\b.*?</\2>)"), 1)).alias("_i"))

    def element(*names: str) -> Column:
        found = [F.regexp_extract("_i", rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1) for n in names]
        plain = [F.trim(F.regexp_replace(f, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")) for f in found]
        for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            plain = [F.replace(p, F.lit(mark), F.lit(sign)) for p in plain]
        return F.coalesce(*[F.nullif(p, F.lit("")) for p in plain])

    reference = F.nullif(F.regexp_extract("_i", r'(?i)<link\b[^>]*href="([^"]+)"', 1), F.lit(""))
    return items.select(
        *keep, element("title").alias("title"), F.coalesce(element("link"), reference).alias("link"), element("pubDate", "published", "updated", "dc:date").alias("published"),
        element("description", "summary", "content").alias("summary"), element("guid", "id").alias("item_id"),
    )


def weight_rows(pages: DataFrame, body: str) -> DataFrame:
    """Rows of a published weight table: name from <th>, two numbers from <td>, section after the special-aggregate marker.

    Rows of one page are ordered by position, so the running marker is a window over a page.
    """
    keep = [c for c in pages.columns if c != body]
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(body, F.lit(r"(?s)(<tr.*?</tr>)"), 1)).alias("position", "_r"))
    plain = F.lower(F.regexp_replace("_r", r"<[^>]+>", " "))
    cells = F.regexp_extract_all("_r", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1)
    number = lambda i: F.trim(F.regexp_replace(F.try_element_at(cells, F.lit(i)), r"<[^>]+>", "")).try_cast("double")
    name = F.trim(F.regexp_replace(F.regexp_extract("_r", r"(?s)<th[^>]*>(.*?)</th>", 1), r"<[^>]+>", " "))
    seen = Window.partitionBy(*keep).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    special = F.max(F.contains(plain, F.lit("special aggregate"))).over(seen)
    out = rows.select(*keep, "position", name.alias("name"), number(1).alias("w1"), number(2).alias("w2"), F.when(special, "special").otherwise("main").alias("section"))
    return out.filter("name <> '' AND w1 IS NOT NULL AND w2 IS NOT NULL")


def dated_notices(pages: DataFrame, body: str, key: str, rules: list[tuple[str, str]] | None = None, high: list[str] | None = None) -> DataFrame:
    """Links in list items with an optional trailing (mm/dd/yyyy); the smallest key's version of each url is kept.

    With ``rules`` (pattern, label) the title's category is the first one it meets, else
    'other'; ``high`` names the categories of high impact.
    """
    items = pages.select(key, F.explode(F.regexp_extract_all(body, F.lit(r"(?s)<li>(.*?)</li>"), 1)).alias("_i"))
    url = F.regexp_extract("_i", r'href="([^"]*)"', 1)
    text = F.trim(F.regexp_replace("_i", r"<[^>]+>", ""))
    stamp = F.regexp_extract(text, r"\((\d{2}/\d{2}/\d{4})\)\s*$", 1)
    rows = items.select(key, url.alias("url"), F.trim(F.regexp_replace(text, r"\(\d{2}/\d{2}/\d{4}\)\s*$", "")).alias("title"), F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("MM/dd/yyyy")).cast("date").alias("day"))
    notices = rows.filter("url <> ''").groupBy("url").agg(F.min(F.struct(key, "title", "day")).alias("_b")).select("url", "_b.title", "_b.day")
    if not rules:
        return notices
    return notices.withColumn("category", first_match("title", rules, "other")).withColumn("high_impact", F.col("category").isin(high or []))


def baseline_rows(df: DataFrame, state: str, counties: list[str], per_unit: int = 36) -> DataFrame:
    """One state's listed counties without the both-sexes (0) and all-ages (0) rows; ``complete`` says each has sex x 18 rows."""
    rows = df.filter((F.col("state") == state) & F.col("county").isin(*counties) & (F.col("sex") != 0) & (F.col("agegrp") != 0))
    n = rows.groupBy("county").agg((F.count(F.lit(1)) == per_unit).alias("complete"))
    return rows.join(n, "county")


def county_to_metro(df: DataFrame) -> DataFrame:
    """Metropolitan rows only, keyed by the padded five-digit county code."""
    return df.filter("kind = 'Metropolitan'").select(F.concat(F.lpad(F.col("state").cast("string"), 2, "0"), F.lpad(F.col("county").cast("string"), 3, "0")).alias("fips"), "metro")


def concordance_rows(df: DataFrame) -> DataFrame:
    """Six-digit codes only, cells trimmed, targets upper case."""
    return df.select(F.trim("code").alias("code"), F.upper(F.trim("target")).alias("target")).filter(F.col("code").rlike(r"^[0-9]{6}$"))


def new_weight_years(incoming: DataFrame, stored: DataFrame, renames: DataFrame) -> DataFrame:
    """Weight rows of years not loaded yet, titles passed through the rename table."""
    fresh = incoming.join(stored.select("weight_year").distinct(), "weight_year", "left_anti")
    return recode(fresh, "name", renames, "old", "new")


def series_slice(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of the listed series."""
    return df.join(wanted.select(key), key, "left_semi")


def survey_expectations(df: DataFrame, period: str, prefix: str) -> DataFrame:
    """yyyymm integers to 'YYYY-MM' with the one column whose name starts with the prefix."""
    column = next(c for c in df.columns if c.lower().startswith(prefix.lower()))
    p = F.col(period).cast("string")
    return df.filter(p.rlike(r"^\d{6}$")).select(F.concat_ws("-", F.substring(p, 1, 4), F.substring(p, 5, 2)).alias("ym"), F.col(column).try_cast("double").alias("value"))


def exact_table(catalogue: DataFrame, description: str) -> DataFrame:
    """Tables whose description equals the wanted text; the shortest name wins."""
    tidy = lambda c: F.regexp_replace(F.upper(F.trim(F.regexp_replace(c, r"\s*\[\d+\]\s*$", ""))), r"\s+", " ")
    hits = catalogue.filter(tidy(F.col("description")) == tidy(F.lit(description)))
    return hits.agg(F.min_by("name", F.struct(F.length("name"), F.col("name"))).alias("name"), F.count(F.lit(1)).alias("candidates"))

import pytest
from pyspark.sql import functions as F

from statloom.functions import text
from statloom.operators import compare
from statloom.sources import fixed_width, sinks, tables


def test_fixed_width_files(spark, tmp_path):
    legacy = "012001000000AB" + "E62" + f"{1234:>12}" + "2000" + "R"
    other = "011001000000CD" + "E62" + f"{5:>12}" + "2000" + "R"
    current = "012001777777" + "F24" + f"{88:>12}" + "2000" + "I"
    assert (len(legacy), len(current)) == (34, 32)
    (tmp_path / "a.txt").write_bytes((legacy + "\n" + other + "\n").encode("latin-1"))
    (tmp_path / "b.txt").write_bytes((current + "\n").encode("latin-1"))
    old = fixed_width.ledger_items(fixed_width.read_lines(spark, str(tmp_path / "a.txt")), 14)
    new = fixed_width.ledger_items(fixed_width.read_lines(spark, str(tmp_path / "b.txt")), 12)
    xw = spark.createDataFrame([("012001000000AB", "000042")], "raw_id string, unit string")
    got = sorted(tuple(r) for r in fixed_width.bridge_eras(old, new, xw).select("unit", "code", "amount", "flag").collect())
    assert got == [("000042", "E62", 1234, "R"), ("777777", "F24", 88, "I")]


def test_disagreeing_ids_stop_the_load(spark):
    df = spark.createDataFrame([("1", True), ("2", False)], "unit string, disagrees boolean")
    with pytest.raises(ValueError):
        fixed_width.require_agreement(df)
    assert fixed_width.require_agreement(df.filter("NOT disagrees")).columns == ["unit"]


def test_padded_tsv(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("series_id  \t value \n CUUR0000SA0 \t  1.5\n")
    df = tables.read_padded_tsv(spark, str(tmp_path / "x.tsv"))
    assert df.columns == ["series_id", "value"] and tuple(df.collect()[0]) == ("CUUR0000SA0", "1.5")


def test_wide_census_row(spark):
    names = ["b15-17", "b18-19", "b20", "b21", "b22-24"]
    wide = spark.createDataFrame([("c", *["1"] * 5)], "geo string, " + ", ".join(f"`{n}` string" for n in names))
    mapping = spark.createDataFrame([(n, "M", "15-19" if i < 2 else "20-24") for i, n in enumerate(names)], "var string, sex string, age_bin string")
    got = {r.age_bin: r["count"] for r in tables.wide_to_tidy(wide, ["geo"], mapping).collect()}
    assert got == {"15-19": 2, "20-24": 3}


def test_notices_with_dates(spark):
    html = '<ul><li><a href="/a">Correction notice</a> (03/04/2021)</li><li><a href="/b">Webinar</a></li><li><a href="/a">again</a></li></ul>'
    rows = {r.url: (r.title, str(r.day)) for r in tables.dated_notices(spark.createDataFrame([(1, html)], "id int, h string"), "h", "id").collect()}
    assert rows["/a"] == ("Correction notice", "2021-03-04") and rows["/b"] == ("Webinar", "None")
    told = tables.dated_notices(spark.createDataFrame([(1, html)], "id int, h string"), "h", "id", [("correct", "correction")], ["correction"]).collect()
    assert {r.url: (r.category, r.high_impact) for r in told} == {"/a": ("correction", True), "/b": ("other", False)}


def test_lenient_numbers(spark):
    cases = {"$1,234.5": 1234.5, " 12% ": 12.0, "-": None, "M": None, "-999.9": None, "N/A": None, "": None, "abc": None, "0": 0.0, "-7": -7.0}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.lenient_number("t").alias("n"))
    assert {r.t: r.n for r in df.collect()} == cases


def test_restricted_and_required_columns(spark):
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("Secret"))
    assert compare.strip_columns(df, ["secret"]).columns == ["a"]
    with pytest.raises(ValueError):
        compare.require_columns(df, ["a", "b"])


def test_sinks_write_per_period(spark, tmp_path):
    df = spark.createDataFrame([("p1", 1, "x"), ("p2", 2, "y")], "period string, n int, hidden string")
    sinks.write_periods(df, str(tmp_path), restricted=["hidden"])
    back = spark.read.parquet(str(tmp_path / "parquet"))
    assert sorted((r.period, r.n) for r in back.collect()) == [("p1", 1), ("p2", 2)] and "hidden" not in back.columns
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_month_melt_wants_enough_months(spark):
    with pytest.raises(ValueError):
        tables.melt_months(spark.createDataFrame([("r", 1.0)], "region string, `2020-01` double"), "region", F.lit(True))


def test_a_rewritten_table_is_seen(spark, tmp_path):
    from statloom.plans.tables import table

    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
        assert table(spark, str(tmp_path), "part").count() == n


def test_many_tables_meet_in_one_shuffle(spark):
    from statloom.sources import sinks

    a = spark.createDataFrame([("x", 2, 20), ("x", 1, 10), ("y", 1, 5)], "unit string, year int, pop int")
    b = spark.createDataFrame([("x", 1, "lo"), ("x", 3, None), (None, 1, "who")], "unit string, year int, note string")
    parts = {"people": (a, "year", ["pop"], "series"), "flags": (b, "year", ["note"], "last"), "notes": (b, "year", ["year", "note"], "series")}
    out = sinks.assembled("unit", parts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {r.unit: r for r in out.collect()}
    assert [tuple(p) for p in got["x"].people] == [(1, 10), (2, 20)] and tuple(got["x"].flags) == (3, None) and len(got["x"].notes) == 2
    assert got["y"].flags is None and got["y"].notes == [] and tuple(got[None].flags) == (1, "who")
    assert plan.count("Exchange hashpartitioning") == 1


def test_feeds_of_both_kinds(spark):
    from statloom.sources import tables

    rss = "<rss><channel><title>no item</title><item><title><![CDATA[A &amp; B]]></title><link>http://x/1</link><pubDate>Mon</pubDate><guid>g1</guid></item><item><title>two</title></item></channel></rss>"
    atom = '<feed><entry><title type="html">C &lt;i&gt;</title><link rel="alternate" href="http://x/3"/><updated>Tue</updated><id>g3</id><summary> s </summary></entry><entrywide><title>no</title></entrywide></feed>'
    docs = spark.createDataFrame([(1, rss), (2, atom), (3, None), (4, "")], "k int, body string")
    got = sorted(map(tuple, tables.feed_items(docs, "body").collect()), key=repr)
    assert got == [(1, "A & B", "http://x/1", "Mon", None, "g1"), (1, "two", None, None, None, None), (2, "C <i>", "http://x/3", "Tue", "s", "g3")]

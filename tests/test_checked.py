import os

import pytest
from pyspark.sql import functions as F

from statloom.sources import checked

SCHEMA = "unit string, year int, amount bigint, secret string"
ROWS = [("a", 2000, 5, "x"), ("a", 2001, 7, "y"), ("b", 2000, None, "z"), (None, 2002, 1, None)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def good(rows=4):
    return [
        checked.exactly("rows", F.count(F.lit(1)), rows), checked.Check("total", F.sum("amount"), 10, 20),
        checked.exactly("years", F.size(F.collect_set("year")), 3), checked.none_where("no amount below zero", F.col("amount") < 0),
    ]


def test_a_table_that_passes_is_written_once_and_measured_on_the_way(spark, tmp_path):
    path, reads = str(tmp_path / "out"), spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    log = checked.checked_write(table(spark).mapInPandas(count, SCHEMA), path, good(), required=["unit"], restricted=["secret"])
    assert [(n, ok) for n, *_, ok in log] == [("rows", True), ("total", True), ("years", True), ("no amount below zero", True)]
    assert spark.read.parquet(path).columns == ["unit", "year", "amount"] and spark.read.parquet(path).count() == 4
    assert reads.value == 4 and os.listdir(tmp_path) == ["out"]
    with pytest.raises(FileExistsError):
        checked.checked_write(table(spark), path, good())


@pytest.mark.parametrize("checks, name", [
    (lambda: good(5), "rows"),
    (lambda: [checked.none_where("unit is known", F.col("unit").isNull())], "unit is known"),
    (lambda: [checked.Check("nothing to measure", F.max(F.when(F.col("amount") > 99, F.col("amount"))), 0)], "nothing"),
])
def test_a_failed_check_leaves_nothing_behind(spark, tmp_path, checks, name):
    path, checks = str(tmp_path / "out"), checks()
    with pytest.raises(checked.CheckFailed, match=name) as refused:
        checked.checked_write(table(spark), path, checks)
    assert os.listdir(tmp_path) == [] and sum(not ok for *_, ok in refused.value.log) == 1
    log = checked.checked_write(table(spark), path, checks, refuse=False)
    assert os.listdir(tmp_path) == [] and log == refused.value.log
    assert checked.log_rows(spark, log).filter("NOT ok").count() == 1


def test_a_bad_column_stops_the_write_before_a_row_is_read(spark, tmp_path):
    for more in ({"required": ["absent"]}, {"restricted": ["SECRET"]}):
        rows = table(spark).withColumnRenamed("secret", "Secret") if "restricted" in more else table(spark).select("*", F.raise_error(F.lit("read")).alias("e"))
        spark.conf.set("spark.sql.caseSensitive", "true")
        try:
            with pytest.raises(ValueError):
                checked.checked_write(rows, str(tmp_path / "out"), good(), **more)
        finally:
            spark.conf.unset("spark.sql.caseSensitive")
    assert os.listdir(tmp_path) == []


def test_a_write_that_breaks_off_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="broken"):
        checked.checked_write(table(spark).withColumn("amount", F.when(F.col("unit") == "b", F.raise_error(F.lit("broken"))).otherwise(F.col("amount"))), str(tmp_path / "out"), good())
    assert os.listdir(tmp_path) == []


def test_column_report(spark):
    got = checked.column_report({"t": table(spark)}, {"t": ["unit", "other"], "u": ["x"]}, spark)
    assert sorted(map(tuple, got.collect())) == [("t", "other", False), ("t", "unit", True), ("u", "x", False)]


def test_digests_ignore_the_order_and_name_what_changed(spark):
    columns = ["unit", "year", "amount", "secret"]
    digests = lambda rows, parts: checked.partition_digests(table(spark, rows).repartition(parts), F.col("year"), columns)
    state = lambda a, b: {r.part: r.state for r in checked.changed_partitions(a, b).collect()}
    first = digests(ROWS, 1)
    assert set(state(digests(ROWS[::-1], 3), first).values()) == {"same"}
    moved = [("a", 2000, 5, "x"), ("a", 2001, 7, None), ("b", 2000, None, "z"), ("b", 2000, None, "z"), (None, 2003, 1, None)]
    assert state(digests(moved, 2), first) == {2000: "changed", 2001: "changed", 2002: "gone", 2003: "new"}
    # a null is no empty text, and a border does not wander
    a, b = [("ab", 1, 1, "")], [("a", 1, 1, "b")]
    assert state(digests(a, 1), digests(b, 1)) == {1: "changed"} and state(digests([("x", 1, 1, None)], 1), digests([("x", 1, 1, "")], 1)) == {1: "changed"}
    prints = [checked.table_fingerprint(digests(r, 2)).first()[0] for r in (ROWS, ROWS[::-1], moved)]
    assert prints[0] == prints[1] != prints[2]
    assert digests([], 1).count() == 0

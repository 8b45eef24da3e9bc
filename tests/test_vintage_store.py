import pytest

from statloom.operators import vintages
from statloom.sources.vintage_store import VintageStore, folders

SCHEMA = "k string, m int, value double, stage string"
P1 = [("a", 1, 1.0, "p"), ("a", 2, 2.0, "p"), ("b", 1, 5.0, None), (None, 1, 7.0, "p")]
P2 = [("a", 1, 1.0 + 1e-12, "p"), ("a", 2, 2.5, "p"), ("b", 1, 5.0, "f"), ("c", 1, 9.0, "p"), (None, 1, 7.0, "p")]
P3 = [("a", 1, 1.0, "p"), ("a", 2, 2.0, "p"), ("c", 1, 9.0, "p")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def store(spark, tmp_path, **more):
    return VintageStore(spark, str(tmp_path / "store"), "k string, m int, value double" + (", stage string" if more else ""), ["k", "m"], buckets=3, **more)


def test_three_pulls_and_the_views_of_each(spark, tmp_path):
    s = store(spark, tmp_path, stage="stage")
    assert [s.append(spark.createDataFrame(p, SCHEMA), name) for name, p in (("one", P1), ("two", P2), ("three", P3))] == [3, 3, 1]
    assert rows(s.pull("two")) == [("a", 2, 2.5, "p", "two"), ("b", 1, 5.0, "f", "two"), ("c", 1, 9.0, "p", "two")]
    assert rows(s.latest("one").drop("pull_id")) == rows(spark.createDataFrame(P1[:3], SCHEMA))
    assert rows(s.latest()) == [("a", 1, 1.0, "p", "one"), ("a", 2, 2.0, "p", "three"), ("b", 1, 5.0, "f", "two"), ("c", 1, 9.0, "p", "two")]
    assert s.history().count() == 7
    # the same rows by a join with the latest view
    batch = vintages.changed_observations(spark.createDataFrame(P2, SCHEMA), spark.createDataFrame(P1, SCHEMA), ["k", "m"], stage="stage")
    assert rows(batch.filter("k IS NOT NULL")) == rows(s.pull("two").drop("pull_id"))


def test_value_only_and_a_wider_tolerance(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(spark.createDataFrame(P1, SCHEMA), "one")
    assert rows(s.changed(spark.createDataFrame(P2, SCHEMA))) == [("a", 2, 2.5), ("c", 1, 9.0)]
    assert rows(s.changed(spark.createDataFrame(P2, SCHEMA), eps=1.0)) == [("c", 1, 9.0)]


def test_only_the_new_pull_is_shuffled(spark, tmp_path):
    s = store(spark, tmp_path, stage="stage")
    for name, p in (("one", P1), ("two", P2)):
        s.append(spark.createDataFrame(p, SCHEMA), name)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # these tables are small enough to be sent whole
    plan = s.changed(spark.createDataFrame(P3, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 1
    assert "Exchange" not in s.latest()._jdf.queryExecution().executedPlan().toString()


def test_what_is_not_committed_does_not_exist(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    s.append(spark.createDataFrame(P1, SCHEMA), "one")
    monkeypatch.setattr(VintageStore, "_commit", lambda *a: 1 // 0)
    with pytest.raises(ZeroDivisionError):  # between the rows and their entry
        s.append(spark.createDataFrame(P2, SCHEMA), "two")
    monkeypatch.undo()
    assert [e.pull_id for e in s.manifest()] == ["one"] and s.history().count() == 3 and len(folders(spark, f"{s.folder}/pulls")) == 2
    assert s.append(spark.createDataFrame(P2, SCHEMA), "two") == 2 and s.append(spark.createDataFrame(P3, SCHEMA), "two") == 2
    assert s.vacuum() == 1 and s.latest().count() == 4


def test_a_new_session_finds_the_tables_and_compaction_keeps_every_version(spark, tmp_path):
    s = store(spark, tmp_path, stage="stage")
    for name, p in (("one", P1), ("two", P2), ("three", P3)):
        s.append(spark.createDataFrame(p, SCHEMA), name)
    before, views = rows(s.history()), [rows(s.latest(n)) for n in ("one", "two", "three")]
    spark.sql(f"DROP TABLE {s.name}")  # the folder stays
    again = store(spark, tmp_path, stage="stage")
    assert rows(again.history()) == before
    again.compact()
    assert len(again._current()) == 1 and rows(again.history()) == before and [rows(again.latest(n)) for n in ("one", "two", "three")] == views
    assert again.vacuum() == 3 and len(folders(spark, f"{again.folder}/pulls")) == 1
    assert again.append(spark.createDataFrame([("z", 1, 0.0, None)], SCHEMA), "four") == 1 and again.latest().count() == 5


def test_only_vintages_past_the_stored_ones_come_in(spark, tmp_path):
    schema = "series string, vintage_m int, obs_m int, value double"
    s = VintageStore(spark, str(tmp_path / "v"), schema, ["series", "vintage_m", "obs_m"], bucket_by=["series"], buckets=2)
    first = [("s", 10, 8, 1.0), ("s", 11, 9, 2.0)]
    more = first + [("s", 11, 10, 9.0), ("s", 12, 10, 3.0), ("s", 12, 1, 3.0), ("t", 5, 5, 4.0)]
    assert s.append_new_vintages(spark.createDataFrame(first, schema), "one", "series", "vintage_m", "obs_m", 5) == 2
    assert s.append_new_vintages(spark.createDataFrame(more, schema), "two", "series", "vintage_m", "obs_m", 5) == 2
    assert rows(s.pull("two").drop("pull_id")) == [("s", 12, 10, 3.0), ("t", 5, 5, 4.0)]
    want = vintages.new_vintages(spark.createDataFrame(more, schema), spark.createDataFrame(first, schema), 5)
    assert rows(want) == rows(s.pull("two").drop("pull_id"))


def test_an_empty_store_and_an_empty_pull(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.history().count() == 0 and s.latest().count() == 0
    assert s.append(spark.createDataFrame([], SCHEMA), "none") == 0 and s.latest().count() == 0
    assert s.append(spark.createDataFrame(P1, SCHEMA), "one") == 3

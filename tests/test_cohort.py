import pytest
from pyspark.sql import functions as F

from statloom.functions.text import age_range, label_age, label_sex, standard_bin
from statloom.operators import cohort

SCHEMA = "year int, unit string, sex string, age_bin string, count long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_known_migration_is_recovered(spark):
    rows = [(2000, u, "M", "20-24", 1000) for u in "AB"] + [(2010, "A", "M", "30-34", 800), (2010, "B", "M", "30-34", 1000)]
    got = {r.unit: r for r in cohort.trace(frame(spark, rows), [(2000, 2010)]).collect()}
    assert got["A"].national_ratio == pytest.approx(0.9)
    assert got["A"].net_residual == pytest.approx(-100) and got["B"].net_residual == pytest.approx(100)
    assert got["A"].birth_years == "1975-1980"


def test_residuals_sum_to_zero_and_small_cohorts_are_low(spark):
    rows = [(2000, u, "F", "5-9", n) for u, n in zip("ABC", (48, 700, 4800))] + [(2010, u, "F", "15-19", n) for u, n in zip("ABC", (50, 650, 4900))]
    got = cohort.trace(frame(spark, rows), [(2000, 2010)]).collect()
    assert sum(r.net_residual for r in got) == pytest.approx(0)
    assert {r.unit: r.reliability for r in got} == {"A": "low", "B": "ok", "C": "ok"}


def test_oldest_bins_flow_into_the_open_bin(spark):
    rows = [(2000, "A", "M", "75-79", 100), (2000, "A", "M", "80-84", 50), (2010, "A", "M", "85+", 60)]
    got = cohort.trace(frame(spark, rows), [(2000, 2010)]).collect()
    assert len(got) == 1 and got[0].count_t0 == 150 and got[0].net_residual == pytest.approx(0)


def test_household_basis_removes_group_quarters(spark):
    rows = [(2000, u, "M", "15-19", 1000, 10) for u in "AB"] + [(2010, "A", "M", "25-29", 1600, 610), (2010, "B", "M", "25-29", 1000, 10)]
    df = frame(spark, rows, SCHEMA + ", gq_count long")
    house = {r.unit: r.net_residual for r in cohort.trace(df, [(2000, 2010)]).collect()}
    total = {r.unit: r.net_residual for r in cohort.trace(df, [(2000, 2010)], basis="total").collect()}
    assert house == {"A": pytest.approx(0), "B": pytest.approx(0)}
    assert total == {"A": pytest.approx(300), "B": pytest.approx(-300)}


def test_units_at_one_end_are_dropped_and_reported(spark):
    rows = [(2000, "A", "M", "0-4", 10), (2010, "A", "M", "10-14", 9), (2010, "Z", "M", "10-14", 500)]
    df = frame(spark, rows)
    assert [r.unit for r in cohort.trace(df, [(2000, 2010)]).collect()] == ["A"]
    assert [(r.unit, r.missing_end) for r in cohort.dropped_units(df, [(2000, 2010)]).collect()] == [("Z", "t0")]


def test_specs_follow_the_ages():
    whole = {label: (sources, target) for label, sources, target in cohort.cohort_specs()}
    assert len(whole) == 16 and whole["0-4"] == (["0-4"], "10-14") and whole["70-74"] == (["70-74"], "80-84")
    assert whole["75-84"] == (["75-79", "80-84"], "85+")
    # the later table knows one bin from 75 to 84
    merged = set(cohort.STANDARD_BINS) - {"75-79", "80-84"} | {"75-84"}
    later = {label: (sources, target) for label, sources, target in cohort.cohort_specs(None, merged)}
    assert later["65-74"] == (["65-69", "70-74"], "75-84") and later["75-84"] == (["75-79", "80-84"], "85+") and len(later) == 15
    # the earlier one does
    earlier = {label: sources for label, sources, _ in cohort.cohort_specs(merged, None)}
    assert earlier["75-84"] == ["75-84"] and len(earlier) == 16
    assert [x[0] for x in cohort.cohort_specs(merged, merged)][-2:] == ["65-74", "75-84"]


def test_a_cohort_with_a_part_missing_is_not_followed():
    labels = [x[0] for x in cohort.cohort_specs(set(cohort.STANDARD_BINS) - {"80-84"}, None)]
    assert not any(x.startswith("75") for x in labels)
    merged = set(cohort.STANDARD_BINS) - {"75-79", "80-84"} | {"75-84"}
    assert not any(x.startswith(("65", "70")) for x, _, _ in cohort.cohort_specs(set(cohort.STANDARD_BINS) - {"65-69"}, merged))
    assert cohort.cohort_specs({"unknown", "85+"}, None) == [] and cohort.cohort_specs(["0-4"], ["5-9"], years=5) == [("0-4", ["0-4"], "5-9")]


def test_periods_are_the_years_there_are(spark):
    df = frame(spark, [(y, "A", "M", "0-4", 1) for y in (2010, 1990, 2000, 2000)])
    assert cohort.consecutive_periods(df) == [(1990, 2000), (2000, 2010)] and cohort.consecutive_periods(df.limit(0)) == []


def test_crosswalk_renames_then_merges(spark):
    rows = [(2000, "01", "a", "M", "0-4", 400, 20), (2000, "02", "b", "M", "0-4", 600, 30), (2000, "09", "old", "M", "0-4", 7, 0)]
    df = frame(spark, rows, "year int, geoid string, name string, sex string, age_bin string, count long, gq_count long")
    out = cohort.apply_crosswalk(df, frame(spark, [("09", "10")], "geoid string, new_geoid string"), frame(spark, [("01", "MG-1"), ("02", "MG-1")], "geoid string, group_id string"))
    got = {r.unit: (r.name, r["count"], r.gq_count) for r in out.collect()}
    assert got == {"MG-1": ("MG-1", 1000, 50), "10": ("old", 7, 0)}


def test_age_labels(spark):
    labels = ["62 to 64 years", "18 to 64 years", "Under 5 years", "85 years and over", "60 and 61 years", "20 years", "all ages"]
    df = frame(spark, [(x,) for x in labels], "t string").select("t", standard_bin("t", cohort.STANDARD_BINS).alias("b"), age_range("t").alias("r"))
    got = {r.t: r.b for r in df.collect()}
    assert got == {"62 to 64 years": "60-64", "18 to 64 years": None, "Under 5 years": "0-4", "85 years and over": "85+", "60 and 61 years": "60-64", "20 years": "20-24", "all ages": None}


def test_label_parts(spark):
    df = frame(spark, [(" !!Total:!!Female:!!85 years and over",), ("Total!!Male",)], "l string")
    got = [(r.s, r.a) for r in df.select(label_sex("l").alias("s"), label_age("l").alias("a")).orderBy("s").collect()]
    assert got == [("F", "85 years and over"), ("M", None)]


def test_pack_fills_absent_cohorts_with_zeros(spark):
    rows = [(2000, u, "M", b, 100) for u in "AB" for b in ("0-4", "5-9")] + [(2010, "A", "M", "10-14", 100), (2010, "A", "M", "15-19", 80), (2010, "B", "M", "10-14", 100)]
    flows = cohort.trace(frame(spark, rows), [(2000, 2010)]).filter(~((F.col("unit") == "B") & (F.col("cohort_age_at_t0") == "5-9")))
    got = {r.unit: r.pairs for r in cohort.pack(flows).collect()}
    assert got == {"A": [100, 100, 40, 80], "B": [100, 100, 0, 0]}

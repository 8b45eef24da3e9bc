import random

import pytest

from statloom.operators import spans


def rows(df):
    return sorted((r.s, r.b) for r in df.select("s", "b").collect())


def brute(some, bands):
    out = []
    for s, lo, hi in some:
        for b, x, y in bands:
            if lo is not None and hi is not None and lo <= hi and (x is None or x <= lo) and (y is None or hi <= y) and (x is None or y is None or x <= y):
                out.append((s, b))
    return sorted(out)


def tables(spark, some, bands):
    return spark.createDataFrame(some, "s int, lo bigint, hi bigint"), spark.createDataFrame(bands, "b int, band_lo bigint, band_hi bigint")


@pytest.mark.parametrize("hot", [200_000, 7])
def test_spans_meet_every_band_that_holds_them(spark, hot):
    rng = random.Random(4)
    some = []
    for i in range(400):
        lo = rng.randrange(-3000, 3000)
        some.append((i, lo, lo + rng.choice([0, 0, 1, 5, 40, 900])))
    some += [(1000 + i, 10, 12) for i in range(60)] + [(2000, None, 3), (2001, 3, None), (2002, 9, 3)]
    bands = []
    for j in range(60):
        lo = rng.randrange(-3000, 3000)
        bands.append((j, lo, lo + rng.choice([0, 1, 2, 3, 7, 8, 64, 500, 4000])))
    bands += [(100, None, 0), (101, 0, None), (102, None, None), (103, 5, 1), (104, -(1 << 40), 1 << 41)]
    got = spans.containing_bands(*tables(spark, some, bands), hot_cell=hot)
    assert rows(got) == brute(some, bands) and len(rows(got)) > 500


def test_no_nested_loop_and_three_cells_a_band_at_most(spark):
    a, b = tables(spark, [(i, i, i + 3) for i in range(50)], [(j, j * 2, j * 3 + 1) for j in range(50)])
    plan = spans.containing_bands(a, b)._jdf.queryExecution().executedPlan().toString()
    equal = [line for line in plan.splitlines() if "Join [" in line and "_cell" in line and "Inner" in line]
    assert "CartesianProduct" not in plan and equal
    assert all((hi >> lv) - (lo >> lv) <= 2 for lo in range(-9, 9) for hi in range(lo, 40) for lv in [(hi - lo + 1).bit_length() - 1])


def test_empty_tables(spark):
    a, b = tables(spark, [(1, 1, 2)], [(1, 0, 9)])
    assert rows(spans.containing_bands(a.limit(0), b)) == [] and rows(spans.containing_bands(a, b.limit(0))) == []

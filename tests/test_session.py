import os

import pytest

from statloom.operators.ordered import written
from statloom.session import ensure_checkpoint_dir, working


def left(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file://")
    return {f for f in os.listdir(folder) if f.startswith("statloom-")}


def test_what_is_written_inside_is_gone_afterwards(spark):
    before = left(spark)
    with working(spark):
        rows = written(written(spark.range(5)).selectExpr("id + 1 AS id")).collect()
        assert len(left(spark) - before) == 2
    assert len(rows) == 5 and left(spark) == before


def test_a_failure_leaves_nothing_and_a_result_can_be_taken_out(spark):
    before = left(spark)
    with pytest.raises(ZeroDivisionError):
        with working(spark):
            written(spark.range(3))
            raise ZeroDivisionError
    assert left(spark) == before
    with working(spark) as outer:
        with working(spark) as made:
            kept = written(spark.range(4))
            written(spark.range(9))
            outer.append(made.pop(0))
        assert kept.count() == 4 and len(left(spark) - before) == 1
    assert left(spark) == before


def test_queries_leave_nothing(spark):
    import __spark_entry__ as entry

    before, queries = left(spark), entry.queries()
    with working(spark):
        for name in ("append_changed_observations", "series_merge_stream", "granger_tests", "checked_write_log"):
            queries[name](spark, "/root/testdata/sf0.001").collect()
        assert left(spark) != before
    assert left(spark) == before

"""Joins of intervals on whole numbers (days, months, cents, microseconds) without a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.ordered import with_one_row

#: Probes of one cell that stay together.
HOT_CELL = 200_000


def containing_bands(spans: DataFrame, bands: DataFrame, hot_cell: int = HOT_CELL) -> DataFrame:
    """Every (span, band) where the band holds the whole span: spans(lo, hi, ...), bands(band_lo, band_hi, ...), both ends included.

    A band lies in at most three cells of the largest power-of-two width that it is
    not below; a span asks, at each of the band widths there are (63 at most) that
    could hold it, for the one cell of its low end.  The join is on equal cells, the
    check is exact, and what it drops are bands that hold the low end's neighbourhood
    only.  A cell asked by more than ``hot_cell`` spans is dealt into pieces, each
    with the cell's bands.  A null end of a band is open; spans without both ends, or
    with the high one below the low one, are in no band, and such bands hold nothing.
    """
    asking = spans.filter("lo <= hi").withColumns({"lo": F.col("lo").cast("bigint"), "hi": F.col("hi").cast("bigint")})
    extent = asking.agg(F.min("lo").alias("_min"), F.max("hi").alias("_max"))
    held = with_one_row(bands, extent)
    held = held.withColumns({"_lo": F.coalesce(F.col("band_lo").cast("bigint"), "_min"), "_hi": F.coalesce(F.col("band_hi").cast("bigint"), "_max")}).filter("_lo <= _hi").drop("_min", "_max")
    held = held.withColumn("_level", _level(F.col("_hi") - F.col("_lo") + 1))
    cells = held.withColumn("_cell", F.explode(F.sequence(F.expr("shiftright(_lo, _level)"), F.expr("shiftright(_hi, _level)"))))

    levels = held.agg(F.coalesce(F.sort_array(F.collect_set("_level")), F.array().cast("array<int>")).alias("_levels"))  # at most 63
    asking = with_one_row(asking, levels).withColumn("_own", _level(F.col("hi") - F.col("lo") + 1))
    asking = asking.withColumn("_level", F.explode(F.filter("_levels", lambda x: x >= F.col("_own")))).drop("_levels", "_own")
    asking = asking.withColumn("_cell", F.expr("shiftright(lo, _level)"))

    hot = asking.groupBy("_level", "_cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_cell)
    pieces = hot.select("_level", "_cell", F.ceil(F.col("_n") / hot_cell).cast("int").alias("_pieces"))
    whole = F.coalesce("_pieces", F.lit(1))
    asking = asking.join(pieces, ["_level", "_cell"], "left").withColumn("_piece", F.pmod(F.monotonically_increasing_id(), whole).cast("int")).drop("_pieces")
    cells = cells.join(pieces, ["_level", "_cell"], "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), whole - 1))).drop("_pieces")
    met = asking.join(cells, ["_level", "_cell", "_piece"]).filter("_lo <= lo AND hi <= _hi")
    return met.drop("_level", "_cell", "_piece", "_lo", "_hi")


def _level(width):
    """Exponent of the largest power of two that is not above a width."""
    return (F.length(F.bin(width)) - 1).cast("int")

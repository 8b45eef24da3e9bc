"""What the corpus operators share: written intermediates and a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.session import scratch_folder

#: monotonically_increasing_id() keeps the row's place in its partition in the low 33 bits.
PLACE_BITS = 33


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder every executor can reach; ``session.working`` deletes it."""
    return scratch_folder(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: lineage ends here, and later readers prune columns."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def text_bytes(column: str) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return text_or_empty(column).cast("binary")


def in_range_order(df: DataFrame, keys: list, name: str) -> DataFrame:
    """``df`` written in the order of ``keys`` with ``part`` and ``place``, its range partition and the row's place in it.

    The keys should end in something unique: range partitioning splits a run of
    equal leading keys only where the later ones differ.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stamped = ranged.withColumn("_at", F.monotonically_increasing_id())
    return stored(
        stamped.withColumn("part", F.shiftright("_at", PLACE_BITS)).withColumn("place", F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)).drop("_at"),
        name,
    )


def with_global_rank(df: DataFrame, keys: list, name: str) -> tuple[DataFrame, int]:
    """``df`` with ``rank`` (from 0) in the order of ``keys``, and the number of rows.

    Only one count for each range partition passes through a window.
    """
    placed = in_range_order(df, keys, name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    ranked = placed.join(F.broadcast(starts), "part")  # one row for each range partition
    return ranked.withColumn("rank", F.col("_start") + F.col("place")).drop("_start", "part", "place"), placed.count()

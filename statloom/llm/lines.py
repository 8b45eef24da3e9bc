"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches.  A batch's line keys are hashed to 128 bits, counted
per key, and merge-anti-joined with the runs stored so far: keys in none of them
are fresh, the others add to a key an earlier run introduced.  The batch is then
stored as a run of its own.  Runs are tables bucketed and sorted by the hash, so
joining a batch with a run, and merging two runs, moves no stored row through a
shuffle.  When a level holds ``FANOUT`` runs they are merged into one of the next
level.  At the end the levels are merged, and keys in enough documents lose their
lines everywhere but in the largest document.

Counts are made in the map tasks first, so a line in a third of all documents is
a few rows; the joins back to documents are ones adaptive execution can split.

Nulls and edge cases: a null or empty text is one empty line; a line repeated in
a document counts once there; rows repeating an id count as documents of their
own, and all rows with the largest id keep the line; a null id is never the
largest, and where a key has only null ids nothing is dropped; an empty table
gives no rows; columns of the input are never looked up by the names used here.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import new_folder, stored, text_or_empty
from statloom.session import remove_folder

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FANOUT = 2
BATCHES = 4
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits: two hashes with unlike seeds."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _long_keys(text: Column, least_length: int) -> Column:
    """Hashes of the distinct keys of at least that many code points."""
    keys = F.filter(F.transform(split_lines(text), line_key), lambda k: F.char_length(k) >= least_length)
    return F.array_distinct(F.transform(keys, key_hash))


@dataclass
class LineRuns:
    """Levels of sorted runs; every run is a bucketed table (h1, h2, docs, largest, fresh)."""

    spark: SparkSession
    buckets: int
    name: str = field(default_factory=lambda: f"statloom_runs_{uuid.uuid4().hex}")
    levels: list[list[str]] = field(default_factory=list)
    made: int = 0
    folders: dict[str, str] = field(default_factory=dict)

    def _write(self, df: DataFrame) -> str:
        table = f"{self.name}_{self.made}"
        self.made += 1
        sorted_rows = df.repartition(self.buckets, *HASH).sortWithinPartitions(*HASH)
        writer = sorted_rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
        self.folders[table] = new_folder(self.spark, "run")
        writer.option("path", self.folders[table]).saveAsTable(table)
        return table

    def _forget(self, table: str) -> None:
        """A table with a path keeps its files when it is dropped."""
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove_folder(self.spark, self.folders.pop(table))

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def add(self, counts: DataFrame) -> str:
        """Anti-joins a batch (h1, h2, docs, largest) with every run and stores it; returns the name of its run."""
        seen = F.lit(False)
        for i, table in enumerate(self.runs()):
            run = self.spark.table(table).where("fresh").select(*HASH, F.lit(True).alias(f"in_{i}"))
            counts = counts.join(run, HASH, "left")
            seen = seen | F.coalesce(F.col(f"in_{i}"), F.lit(False))
        table = self._write(counts.select(*HASH, "docs", "largest", (~seen).alias("fresh")))
        self._place(table, 0)
        return table

    def _place(self, table: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= FANOUT:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            self._place(merged, level + 1)

    def _merge(self, tables: list[str]) -> str:
        """One run out of several: a full merge join of sorted buckets for each."""
        out = self._write(self._merged(tables))
        for table in tables:
            self._forget(table)
        return out

    def _merged(self, tables: list[str]) -> DataFrame:
        out = self.spark.table(tables[0])
        for table in tables[1:]:
            other = self.spark.table(table).select(*HASH, F.col("docs").alias("d"), F.col("largest").alias("l"), F.col("fresh").alias("f"))
            out = out.join(other, HASH, "full").select(
                *HASH,
                (F.coalesce("docs", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("docs"),
                F.greatest("largest", "l").alias("largest"),
                (F.coalesce("fresh", F.lit(False)) | F.coalesce("f", F.lit(False))).alias("fresh"),
            )
        return out

    def totals(self) -> DataFrame:
        """h1, h2, docs, largest over all runs."""
        return self._merged(self.runs()).drop("fresh")

    def drop(self) -> None:
        for table in list(self.folders):
            self._forget(table)
        self.levels = []


def batch_counts(lines: DataFrame) -> DataFrame:
    """Documents and largest id of every key of a batch."""
    return lines.groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("largest"))


def repeated_keys(lines: DataFrame, least_docs: int, batches: int = BATCHES) -> DataFrame:
    """h1, h2 and largest id of every key in at least that many documents, found batch by batch."""
    spark = lines.sparkSession
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        for batch in range(batches):
            runs.add(batch_counts(lines.where(F.col("batch") == batch)))
        return stored(runs.totals().where(F.col("docs") >= least_docs).select(*HASH, "largest"), "repeated-lines")
    finally:
        runs.drop()


def _lines(docs: DataFrame, id_col: str, text_col: str, least_length: int, batches: int) -> DataFrame:
    text = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.explode(_long_keys(text, least_length)).alias("k"))
    batch = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches)).cast("int")
    return rows.select("doc_id", "text_hash", "k.h1", "k.h2", batch.alias("batch"))


def with_kept_lines(docs: DataFrame, least_length: int = 40, least_docs: int = 5, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (text without the dropped lines), n_lines, n_dropped and the other columns as struct ``row``."""
    lines = stored(_lines(docs, id_col, text_col, least_length, batches), "line-keys")
    hits = repeated_keys(lines, least_docs, batches)
    lost = lines.join(hits, HASH).where(F.coalesce(F.col("doc_id") < F.col("largest"), F.col("largest").isNotNull()))
    lost = lost.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(*HASH)).alias("lost"))
    lost = lost.select(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash"), "lost")
    text = text_or_empty(text_col)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    rows = docs.select(others, F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    joined = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash")), "left")
    stay = F.filter(split_lines(F.col("text")), lambda x: ~F.array_contains(F.col("lost"), key_hash(line_key(x))))
    kept = F.when(F.col("lost").isNull(), split_lines(F.col("text"))).otherwise(stay)
    cut = joined.select("row", "doc_id", "text", "lost", kept.alias("stay"))
    return cut.select(
        "row",
        "doc_id",
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join("stay", "\n")).alias("kept"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("bigint").alias("n_lines"),
        F.size("stay").cast("bigint").alias("n_kept"),
    ).withColumn("n_dropped", F.col("n_lines") - F.col("n_kept")).drop("n_kept")


def deduplicated(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text; ``length_col``, where there is one, counts what is left."""
    kept = with_kept_lines(docs, text_col=text_col, **options)
    new = {text_col: F.col("kept"), length_col: F.length("kept").cast("bigint")}
    return kept.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])

"""A store of vintaged observations to which pulls are only ever appended.

All pulls are partitions of one table, bucketed and sorted by the key.  A one-row
manifest entry, written last, commits a pull; what has no entry does not exist: a
pull that broke off leaves nothing a reader sees, and the same pull twice is stored
once.  The table's buckets are read as they lie, so finding what a new pull changes
shuffles the new pull alone.  ``compact`` writes the pulls so far as one partition;
every version stays.  A row with a null in its key is no observation and left out.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "n int, kind string, part string, pull_id string, rows bigint"


def _place(spark: SparkSession, folder: str):
    """A folder's file system and path, of whatever store Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def folders(spark: SparkSession, folder: str) -> list[str]:
    files, path = _place(spark, folder)
    return sorted(e.getPath().getName() for e in files.listStatus(path) if e.isDirectory()) if files.exists(path) else []


def finished(spark: SparkSession, folder: str) -> list[str]:
    """Names of the completely written folders below ``folder``."""
    files, path = _place(spark, folder)
    return [name for name in folders(spark, folder) if files.exists(path.suffix(f"/{name}/_SUCCESS"))]


def removed(spark: SparkSession, folder: str) -> bool:
    files, path = _place(spark, folder)
    return files.delete(path, True)


class VintageStore:
    """Observations (keys, value, stage if there is one) in the versions of their pulls.

    ``schema`` is the DDL of keys, value and stage; ``bucket_by`` are the leading
    columns that readers group by, all keys by default.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], value: str = "value", stage: str | None = None, bucket_by: list[str] | None = None, buckets: int = 16):
        self.spark, self.folder, self.keys, self.value, self.stage = spark, folder.rstrip("/"), keys, value, stage
        self.bucket_by, self.buckets = bucket_by or keys, buckets
        self.content = [value, *([stage] if stage else [])]
        self.columns = [*keys, *self.content, "pull_id", "seq"]
        self.name = f"statloom_vintages_{zlib.crc32(self.folder.encode()):08x}"
        if not spark.catalog.tableExists(self.name):  # the catalogue of a new session is told of the folder first
            by = ", ".join(f"`{c}`" for c in self.bucket_by)
            spark.sql(
                f"CREATE TABLE {self.name} ({schema}, pull_id string, seq int, part string) USING parquet PARTITIONED BY (part) "
                f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self.folder}/pulls'"
            )
            if folders(spark, f"{self.folder}/pulls"):
                spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def manifest(self) -> list:
        """Committed entries in their order."""
        names = finished(self.spark, f"{self.folder}/manifest")
        if not names:
            return []
        return sorted(self.spark.read.schema(MANIFEST).parquet(*[f"{self.folder}/manifest/{n}" for n in names]).collect(), key=lambda r: r.n)

    def _current(self) -> list:
        """The newest merged partition and the pulls after it."""
        entries = self.manifest()
        start = max((i for i, e in enumerate(entries) if e.kind == "merge"), default=0)
        return entries[start:]

    def _write(self, rows: DataFrame, kind: str, pull_id: str | None) -> int:
        part = uuid.uuid4().hex
        dealt = rows.select(*self.columns, F.lit(part).alias("part"))
        dealt.write.mode("append").format("parquet").partitionBy("part").bucketBy(self.buckets, *self.bucket_by).sortBy(*self.bucket_by).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        count = self.spark.table(self.name).filter(F.col("part") == part).count()
        self._commit(kind, part, pull_id, count)
        return count

    def _commit(self, kind: str, part: str, pull_id: str | None, rows: int) -> None:
        n = max((e.n for e in self.manifest()), default=0) + 1
        # fails if another writer has committed this number meanwhile
        self.spark.createDataFrame([(n, kind, part, pull_id, rows)], MANIFEST).coalesce(1).write.parquet(f"{self.folder}/manifest/{n:08d}")

    def history(self) -> DataFrame:
        """Every stored version: keys, value, stage, pull_id and seq, the order of the pulls."""
        parts = [e.part for e in self._current()]
        return self.spark.table(self.name).filter(F.col("part").isin(parts)).select(*self.columns)

    def latest(self, as_of: str | None = None) -> DataFrame:
        """The newest version of every observation, or the newest as of a pull."""
        rows = self.history()
        if as_of is not None:
            rows = rows.filter(F.col("seq") <= next(e.n for e in self.manifest() if e.pull_id == as_of))
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.content, "pull_id"), "seq").alias("_v")).select(*self.keys, "_v.*")

    def pull(self, pull_id: str) -> DataFrame:
        """The rows a pull appended."""
        return self.history().filter(F.col("pull_id") == pull_id).drop("seq")

    def changed(self, incoming: DataFrame, eps: float = 1e-9) -> DataFrame:
        """Rows of ``incoming`` that are new, moved by more than ``eps`` or changed stage; of several rows of a key the largest counts."""
        known = incoming.dropna(subset=self.keys).repartition(self.buckets, *self.bucket_by)
        new = known.groupBy(*self.keys).agg(F.max(F.struct(*self.content)).alias("_new"))
        met = new.join(self.latest().select(*self.keys, F.struct(*self.content).alias("_old")), self.keys, "left")
        new_value, old_value = F.col(f"_new.{self.value}"), F.col(f"_old.{self.value}")
        moved = old_value.isNull() | (F.abs(new_value - old_value) > eps)
        if self.stage:
            moved = moved | ~F.col(f"_new.{self.stage}").eqNullSafe(F.col(f"_old.{self.stage}"))
        return met.filter(moved).select(*self.keys, "_new.*")

    def append(self, incoming: DataFrame, pull_id: str, eps: float = 1e-9) -> int:
        """Store what a pull changes and commit it; the number of rows.  A pull that is committed already is left alone."""
        return self._store(pull_id, lambda: self.changed(incoming, eps))

    def append_new_vintages(self, incoming: DataFrame, pull_id: str, series: str, vintage: str, obs: str, retain: int = 98) -> int:
        """Store the vintages past the stored maximum of their series, observations within ``retain`` months of the vintage."""

        def new() -> DataFrame:
            within = incoming.dropna(subset=self.keys).filter(F.col(obs) >= F.col(vintage) - retain).repartition(self.buckets, *self.bucket_by)
            top = self.history().groupBy(series).agg(F.max(vintage).alias("_top"))
            return within.join(top, series, "left").filter(F.col("_top").isNull() | (F.col(vintage) > F.col("_top"))).drop("_top")

        return self._store(pull_id, new)

    def _store(self, pull_id: str, rows) -> int:
        entries = self.manifest()
        for entry in entries:
            if entry.pull_id == pull_id:
                return entry.rows
        seq = max((e.n for e in entries), default=0) + 1
        return self._write(rows().withColumns({"pull_id": F.lit(pull_id), "seq": F.lit(seq)}), "pull", pull_id)

    def compact(self) -> None:
        """All versions so far as one partition; readers of the earlier ones are not disturbed."""
        if len(self._current()) > 1:
            self._write(self.history(), "merge", None)

    def vacuum(self) -> int:
        """Delete partitions that no reader needs: merged ones and those of pulls that broke off; how many."""
        needed = {f"part={e.part}" for e in self._current()}
        idle = [p for p in folders(self.spark, f"{self.folder}/pulls") if p.startswith("part=") and p not in needed]
        for name in idle:
            removed(self.spark, f"{self.folder}/pulls/{name}")
        self.spark.catalog.refreshTable(self.name)
        return len(idle)

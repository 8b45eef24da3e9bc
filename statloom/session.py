"""Session settings shared by tests, bench and ad-hoc runs.

On a cluster the caller brings its own session; nothing below is required by
the operators except that adaptive execution stays on (its default), because
skewed joins are split and small aggregates are turned into broadcast joins
from measured sizes rather than from hints.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_SCOPES = threading.local()


def build_session(app: str = "statloom", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and bench runs."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STATLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and the session is local (tests) is a scratch folder chosen here, removed at exit.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="statloom-checkpoint-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
        context.setCheckpointDir(current)
    return current


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder; ``working`` deletes it if one is open."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/statloom-{name}-{uuid.uuid4().hex}"
    for scope in getattr(_SCOPES, "open", [])[-1:]:
        scope.append(path)
    return path


@contextmanager
def working(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the folders that are written inside, also after a failure, but those taken out of the list.

    Use a result inside, or take its folder out: what is lazily read from a deleted
    folder fails.
    """
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    scope: list[str] = []
    _SCOPES.open.append(scope)
    try:
        yield scope
    finally:
        _SCOPES.open.pop()
        for path in scope:
            remove_folder(spark, path)


@contextmanager
def outliving() -> Iterator[None]:
    """What is written inside belongs to no scope: tables that later queries of the session read again."""
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    _SCOPES.open.append([])
    try:
        yield
    finally:
        _SCOPES.open.pop()


def hand_over(scope: list[str]) -> None:
    """Leave what is in a scope to the one around it, or to the caller if there is none."""
    place = next(i for i, s in enumerate(_SCOPES.open) if s is scope)
    if place:
        _SCOPES.open[place - 1].extend(scope)
    scope.clear()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

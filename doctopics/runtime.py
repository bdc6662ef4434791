"""Session helpers shared by all jobs: shared work folder, written tables, bounded broadcasts, parallel fits."""

from __future__ import annotations

import io
import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool
from pathlib import Path
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

# A side is broadcast only when its row count is known not to exceed this.
MAX_BROADCAST_ROWS = 200_000
# Inputs below this size per core are spread over all cores before CPU-heavy text work.
SPREAD_BYTES_PER_CORE = 32 * 1024 * 1024
# Smallest useful partition of a persisted fit input.
TARGET_PARTITION_BYTES = 16 * 1024 * 1024


_shipped_to: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application; they need no PYTHONPATH then."""
    app = spark.sparkContext.applicationId
    if app in _shipped_to:
        return
    here = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    # addPyFile copies the file to Spark's own file server at once
    path = os.path.join(tempfile.mkdtemp(prefix="doctopics-"), "doctopics.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped_to.add(app)


def local_checkpoint_folder(spark: SparkSession) -> None:
    """For a session on one machine that names no folder, as tests and trials do, make one. Never on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="doctopics-"))


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` or with ``setCheckpointDir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/doctopics/{name}-{uuid.uuid4().hex}"


_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_removing: dict[str, int] = {}
_removing_lock = threading.Lock()


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a statement when it ends, not at some later garbage collection of the driver.

    Should a part of them be wanted again, Spark computes it again.
    """
    app = spark.sparkContext.applicationId
    with _removing_lock:
        if not _removing.get(app) and spark.conf.get(_REMOVE_SHUFFLES, None) is not None:
            as_set = True  # the session's own choice stays
        else:
            as_set = False
            _removing[app] = _removing.get(app, 0) + 1
            spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if not as_set:
            with _removing_lock:
                _removing[app] -= 1
                if not _removing[app]:
                    spark.conf.unset(_REMOVE_SHUFFLES)


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table, for inputs that several passes read.

    What the write shuffled is deleted with it, so the disk holds the table alone.
    """
    path = work_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with _shuffles_removed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, rows: int | None, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if ``rows`` (a proven bound) is small; else leave a shuffle join to AQE."""
    return F.broadcast(df) if rows is not None and rows <= limit else df


def counted_broadcast(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Same for a side of unknown size: count it first. It is persisted, so counting does not compute it twice."""
    side = df.persist()
    return broadcast_within(side, side.count(), limit)


def one_row(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    out = first.withColumn("_one", F.lit(1))
    for part in others:
        out = out.join(F.broadcast(part.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")


def plan_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input (few row groups) over all cores; large inputs keep their scan splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(df) < cores * SPREAD_BYTES_PER_CORE:
        return df.repartition(cores)
    return df


def sized(df: DataFrame, rows: int, bytes_per_row: int, least: int = 1) -> DataFrame:
    """Fewer partitions (``least`` of them) for data an iterative fit rereads, when they would hold under 16 MB; never more."""
    wanted = max(least, -(-rows * bytes_per_row // TARGET_PARTITION_BYTES))
    return df.coalesce(wanted) if wanted < df.rdd.getNumPartitions() else df


def run_parallel(tasks: Sequence[Callable[[], T]], parallelism: int = 4) -> list[T]:
    """Submit independent Spark jobs (model fits of a grid) from a few driver threads, results in order."""
    if parallelism <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(lambda t: t()), tasks, chunksize=1)

"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# A hot key may hold a large share of all rows. Letting adaptive execution split
# a skewed join even when the split costs one more shuffle keeps such a key off
# a single task; without skew the plan is unchanged. Ids share long prefixes and
# sort slowly, so a join hashes a side whose every partition was measured to fit
# and sorts otherwise.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Graph tables have 12 folders; a task that keeps them all open need not sort.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    # Ids with common prefixes compress well; a file several times as large in memory
    # must not count as small enough to be sent to every executor.
    "spark.sql.sources.fileCompressionFactor": "4.0",
}

# Input files per shuffle partition at the start. In memory their rows take about ten times
# as much, which a task must be able to sort without writing runs.
SHUFFLE_PARTITION_BYTES = 16 << 20

# Deletes the shuffle files of a query when it has ended; else they stay until the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_freeing: dict[int, tuple[int, str]] = {}  # by session: who wants that now, and the setting before
_freeing_lock = threading.Lock()

_local_staging: dict[str, str] = {}
_releasing: set[str] = set()


def tune(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Apply the runtime settings the operators rely on to a running session.

    This changes the caller's session: opening a workspace calls it. With
    ``input_bytes`` shuffles also start with enough partitions for that much
    input, where the session's own number is smaller.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    wanted = shuffle_partitions(input_bytes, spark.sparkContext.defaultParallelism)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return spark


def build_session(app_name: str = "ledgerloom", master: str | None = None, **settings: str) -> SparkSession:
    """Create a session; ``settings`` use ``_`` for ``.`` in the key."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shuffle_partitions(shuffled_bytes: int, cores: int) -> int:
    """Shuffle partitions that keep each near 16 MiB of files, at least one per core.

    Adaptive execution merges partitions that turn out small, so it is safe to
    estimate high.
    """
    return max(cores, -(-shuffled_bytes // SHUFFLE_PARTITION_BYTES))


def staging_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's checkpoint folder.

    Where none is set, a temporary folder serves a local session; on a cluster
    that, or a folder of the machine's own file system, would be visible to one
    machine only, so both are refused.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    local = spark.sparkContext.master.startswith("local")
    if not local and (not shared or shared.startswith("file:")):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if shared:
        return shared
    app = spark.sparkContext.applicationId
    if app not in _local_staging:
        _local_staging[app] = tempfile.mkdtemp(prefix="ledgerloom-")
    return _local_staging[app]


def _staged_root(spark: SparkSession) -> str:
    return posixpath.join(staging_dir(spark), f"ledgerloom-{spark.sparkContext.applicationId}")


def staging_path(spark: SparkSession, name: str, owner: str = "queries") -> str:
    """A new, unused path among the tables ``owner`` stages in this application."""
    if spark.sparkContext.applicationId not in _releasing:
        _releasing.add(spark.sparkContext.applicationId)
        atexit.register(_release_at_exit, spark, spark.sparkContext.applicationId)
    return posixpath.join(_staged_root(spark), owner, f"{name}-{uuid.uuid4().hex}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system that Spark reaches."""
    target, files = _files(spark, path)
    files.delete(target, True)


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in order; none if there is no such folder."""
    target, files = _files(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty file, which must not be there yet; it is there from one moment to the next."""
    target, files = _files(spark, path)
    files.create(target, False).close()


def release(spark: SparkSession, owner: str | None = None) -> None:
    """Delete what ``owner``, or the whole application, has staged; results that were not read yet are lost."""
    root = _staged_root(spark)
    delete(spark, posixpath.join(root, owner) if owner else root)


def _release_at_exit(spark: SparkSession, app: str) -> None:
    """What an application staged goes with it, if its session still runs then or the folder is its own."""
    try:
        release(spark)
    except Exception:  # the session is gone; a retention rule of the shared folder has to do it
        shutil.rmtree(_local_staging.get(app, ""), ignore_errors=True)


def side_by_side(spark: SparkSession, function: Callable[[Any], Any], given: Iterable[Any]) -> list:
    """``function`` of each of a few ``given`` values, in their order, with the jobs of all of them running at once.

    For jobs of so few tasks that one alone leaves cores idle. The first error is raised when all have ended.
    """
    given = list(given)
    with ThreadPoolExecutor(max(1, len(given))) as pool:
        # Each call takes the properties that this thread has in Spark now.
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(function), x) for x in given]]


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that begin here leave no shuffle files behind, so those of one write are gone at the next.

    For queries that are run once: run again, the same frame would have to shuffle again.
    """
    key = id(spark)
    with _freeing_lock:
        users, before = _freeing.get(key) or (0, spark.conf.get(FREE_SHUFFLES, "false"))
        _freeing[key] = users + 1, before
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _freeing_lock:
            users, before = _freeing.pop(key)
            if users > 1:
                _freeing[key] = users - 1, before
            else:
                spark.conf.set(FREE_SHUFFLES, before)


def stage(df: DataFrame, name: str, partition_by: str | None = None, owner: str = "queries") -> DataFrame:
    """Write ``df`` to the staging folder and read it back.

    ``owner`` can later ``release`` its tables together.

    The result has a file scan as its whole lineage, so a lost executor costs a
    re-read and every consumer gets column pruning and filter pushdown.
    """
    path = staging_path(df.sparkSession, name, owner)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with freed_shuffles(df.sparkSession):
        writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.select(*df.columns)

"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "seriesloom", **conf: str) -> SparkSession:
    """A session with the library's defaults; master and sizing come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A temporary folder is used only on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="seriesloom-")
    spark.sparkContext.setCheckpointDir(path)
    return path


_scope: ContextVar[str | None] = ContextVar("scratch_scope", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, or below the scope that is open."""
    return f"{_scope.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside go at the end. For jobs that leave only stored tables behind."""
    path = f"{shared_dir(spark)}/scope-{uuid.uuid4().hex}"
    token = _scope.set(path)
    try:
        yield
    finally:
        _scope.reset(token)
        remove_path(spark, path)


#: Queries free their shuffle files when they end. Else those stay until the driver collects its garbage, and the
#: disk holds the shuffles of every step of a job at once.
FREES_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Writes to a few partitions keep a file open for each, instead of sorting the rows by partition.
OPEN_FILES = {"spark.sql.maxConcurrentOutputFileWriters": "32"}
#: Codec of large tables that are written and read a few times: a fifth smaller than the default.
CODEC = "zstd"
_held: WeakKeyDictionary[SparkSession, dict[str, tuple[int, str | None]]] = WeakKeyDictionary()
_held_lock = Lock()


@contextmanager
def held_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The settings hold for queries that begin inside. The last of several threads inside restores what was before."""
    with _held_lock:
        held = _held.setdefault(spark, {})
        for key, value in settings.items():
            inside, before = held.get(key) or (0, spark.conf.get(key, None))
            held[key] = (inside + 1, before)
            spark.conf.set(key, value)
    try:
        yield
    finally:
        with _held_lock:
            for key in settings:
                inside, before = held.pop(key)
                if inside > 1:
                    held[key] = (inside - 1, before)
                elif before is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, before)


def _store(df: DataFrame, path: str, **options: str) -> DataFrame:
    with held_conf(df.sparkSession, FREES_SHUFFLES):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Compute once into a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and later readers still prune columns and push
    filters down, which a checkpointed row stream cannot. ``options`` are the writer's.
    """
    return _store(df, scratch_path(df.sparkSession, "table"), **options)


def materialize_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Like ``materialize`` for the frame that ``make`` gives; the intermediate tables made for it go."""
    path = scratch_path(spark, "table")
    with scratch_scope(spark):
        return _store(make(), path, compression=CODEC)

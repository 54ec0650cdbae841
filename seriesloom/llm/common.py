"""Helpers the text operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the decontamination contract, on UTF-8 bytes with A-Z in lower case: every byte from 0x80 belongs to a word.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


#: Bytes of one Arrow batch, where the session has no bound of its own. Texts are long, and both sides hold a batch whole.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_kept: tuple = (None, None)
_stage: str | None = None


def announce(stage: str) -> None:
    """A worker that begins with another operator drops the caches of the one before."""
    global _kept, _stage
    if _stage != stage:
        _kept, _stage = (None, None), stage


def worker_state(key, make: Callable):
    """What a Python worker keeps from task to task: the caches of one operator at a time.

    Workers are reused, so caches of all the operators of a pipeline would add up in each of them. Another key drops what is kept.
    """
    global _kept
    if _kept[0] != key:
        _kept = (None, None)
        _kept = (key, make())
    return _kept[1]


def give_back() -> None:
    """Free memory that a Python worker holds goes back to the system: the worker outlives its task by a minute."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def bound_batches(spark: SparkSession) -> None:
    """Set BATCH_BYTES for the session, unless it says how many bytes an Arrow batch may have."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def map_streams(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, stage: str | None = None) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes; a worker gives its free memory back at the end of each task."""

    stage = stage or rows.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        announce(stage)
        try:
            yield from rows(batches)
        finally:
            give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """One output batch for each input batch; ``None`` drops it. Nothing is kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := rows(batch)) is not None:
                yield out

    return map_streams(df, run, schema, rows.__module__)


def hidden(df: DataFrame, *names: str) -> dict[str, str]:
    """For each wanted helper column a name that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out[name] = new
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

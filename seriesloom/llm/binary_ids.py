"""Token ids in ORC: integer run lengths, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_batches, map_streams, partitions, text_or_empty
from .tokens import tokenizer_path, worker_encoder

#: Rows and bytes of text that are encoded at a time; a longer text alone.
SLICE_ROWS, SLICE_BYTES = 8192, 16 << 20
SCHEMA = "doc_id long, shard int, start_in_shard long, n_tokens long, ids array<int>"


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a bounded number of rows and bytes of the second column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    first = held = 0
    for k, size in enumerate(sizes.tolist()):
        if k > first and (k - first >= SLICE_ROWS or held + size > SLICE_BYTES):
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += size
    if batch.num_rows > first:
        yield batch.slice(first)


def write_ids(docs: DataFrame, folder: str, path: str | None = None, text: str = "text", key: str = "doc_id", end_id: int = 1, stripe_bytes: int = 32 << 20, index_rows: int = 1000) -> None:
    """Encode whole texts, append ``end_id``, and write ORC files in ascending order of the key (nulls first, ties by a hash of the text).

    The files of ascending shards follow each other; a shard's rows are sorted. ORC codes runs of integers; every ``index_rows`` rows
    have an index entry and a Bloom filter on ``doc_id``, so a reader prunes stripes by metadata and takes them in parallel.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole):
                flat, ends = worker_encoder(path).batch(batch.column(1).to_pylist())
                n = np.arange(1, len(ends) + 1)
                ids = np.insert(flat.view("<i4"), ends, end_id)
                ends = ends + n
                sizes = np.diff(np.append(0, ends))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), shard, np.int32)), pa.array(at + ends - sizes), pa.array(sizes), lists], names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids"])
                at += int(ends[-1])

    cols = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    # The bounds of the ranges are sampled by the driver: numbers only, no texts.
    ordered = cols.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    writer = map_streams(ordered, run, SCHEMA).write.format("orc").mode("error")
    options = {"compression": "snappy", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(index_rows), "orc.stripe.size": str(stripe_bytes)}
    writer.options(**options).save(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, from the files."""
    rows = spark.read.schema(SCHEMA).orc(folder)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # One row for each shard, that is for each write task: the running sum is over files, not over documents.
    before = totals.alias("a").select("shard", F.coalesce(F.sum("total").over(_running()), F.lit(0)).alias("before"))
    return rows.join(materialize(before), "shard").select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "ids")


def _running():
    from pyspark.sql import Window

    return Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)


def id_checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of little-endian unsigned 32-bit ids), all from the ids that the files hold."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(2)
        values = memoryview(np.ascontiguousarray(ids.values.to_numpy(), dtype="<i4")).cast("B")
        ends = ids.offsets.to_numpy().tolist()
        crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
        sizes = np.diff(np.asarray(ends, np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(rows.select("doc_id", "start", "ids"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")

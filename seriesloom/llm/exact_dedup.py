"""Exact deduplication by keyed streaming state that is kept on disk and never expires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import hidden

#: The characters that the comparison leaves out.
BLANKS = " \t\n\x0b\x0c\r"
#: Tasks, at most, that the rows of one digest are dealt over for the comparison of their bytes.
SALTS = 16
#: What a micro-batch reads of the content store, where the caller says nothing.
BATCH_BYTES = 1 << 33
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State on disk without space set aside in advance, which would be 4 MB for each of many small stores. All stores of an executor share
#: one bound of memory (MB), and a store is closed when its task has committed, as an executor may hold hundreds of partitions.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


class ExactDedup:
    """Groups of equal texts, and in each the row that stays: the longest original text, then the smallest id.

    Every row gets a content locator and goes into a table in the shared folder (the content store). A stream reads digest,
    length, id and locator from there; its state, in RocksDB, holds for each digest the row that stays and the number of rows,
    for ever. Rows of one digest are combined before the shuffle, so a text that fills a third of the table sends one row from
    each task. On hits, that is digests of more than one row, the full bytes of all rows are compared; different bytes fail
    the job. Null texts count as empty; null ids come last; of wholly equal rows one stays. Other columns pass through,
    whatever their names. An empty table gives an empty result.

    ``bytes_per_batch`` bounds what one micro-batch reads of the content store.
    """

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", bytes_per_batch: int = BATCH_BYTES):
        self.spark: SparkSession = docs.sparkSession
        self.text, self.key, self.columns, self.bytes_per_batch = text, key, docs.columns, bytes_per_batch
        self.n = hidden(docs, "digest", "points", "locator", "keep", "size", "stays", "at", "salt")
        self.path = scratch_path(self.spark, "content")
        stored = docs.withColumns(
            {
                self.n["digest"]: F.sha2(normalised(text), 256),
                self.n["points"]: F.length(F.coalesce(F.col(text), F.lit(""))).cast("long"),
                self.n["locator"]: F.monotonically_increasing_id(),
            }
        )
        stored.write.parquet(self.path)
        self.schema = stored.schema
        self.store = self.spark.read.schema(self.schema).parquet(self.path)

    def state(self) -> DataFrame:
        """digest, number of rows, and id and locator of the row that stays, read from the state itself."""
        digest, points, locator = (F.col(self.n[x]) for x in ("digest", "points", "locator"))
        rows = self.spark.readStream.schema(self.schema).option("maxBytesPerTrigger", self.bytes_per_batch).parquet(self.path).select(digest.alias("digest"), points, self.key, locator)
        best = F.struct((-points).alias("p"), F.col(self.key).isNull().alias("u"), F.col(self.key).alias("k"), locator.alias("l"))
        held = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min(best).alias("best"))
        where, before = scratch_path(self.spark, "dedup-state"), {k: self.spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            self.spark.conf.set(k, v)
        try:
            query = held.writeStream.outputMode("update").format("noop").option("checkpointLocation", where).trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        found = self.spark.read.format("statestore").load(where)
        return materialize(found.select("key.digest", F.col("value.count").alias("size"), F.col("value.min.k").alias("keep"), F.col("value.min.l").alias("at")))

    def check_bytes(self, state: DataFrame) -> None:
        """Compare the full bytes of every hit with the others of its digest.

        Rows meet the digests in question under a salt, so a large group is in many tasks and each sends its least and
        greatest text on.
        """
        digest, salt = self.n["digest"], self.n["salt"]
        asked = state.filter("size > 1").select(F.col("digest").alias(digest), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        rows = self.store.select(digest, self.text, F.pmod(self.n["locator"], F.lit(SALTS)).cast("int").alias(salt))
        hits = rows.join(asked, [digest, salt], "left_semi")
        body = normalised(self.text)
        odd = hits.groupBy(digest).agg(F.min(body).alias("lo"), F.max(body).alias("hi")).filter("lo != hi").limit(1).collect()
        if odd:
            raise RuntimeError(f"different texts have the digest {odd[0][digest]}")

    def rows(self) -> DataFrame:
        """All columns of the table, then those of ``n``: digest, points, locator, keep (id of the row that stays), size, stays."""
        n = self.n
        if self.store.isEmpty():
            return self.store.withColumns({n["keep"]: F.col(self.key), n["size"]: F.lit(0).cast("long"), n["stays"]: F.lit(True)})
        state = self.state()
        self.check_bytes(state)
        names = {"digest": n["digest"], "keep": n["keep"], "size": n["size"], "at": n["at"]}
        found = state.select(*[F.col(a).alias(b) for a, b in names.items()])
        joined = self.store.join(found, n["digest"], "left")
        return joined.withColumn(n["stays"], F.col(n["at"]) == F.col(n["locator"])).drop(n["at"])


def dedup_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256."""
    work = ExactDedup(docs.select(key, text), text, key)
    n = work.n
    return work.rows().select(
        key, F.col(n["keep"]).alias("keep_id"), F.col(n["size"]).alias("group_size"), F.col(n["stays"]).alias("kept"), F.col(n["digest"]).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    work = ExactDedup(docs, text, key)
    return work.rows().filter(F.col(work.n["stays"])).select(*docs.columns)

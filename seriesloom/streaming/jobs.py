"""Structured Streaming forms of scoring and feature building."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from seriesloom.functions.dates import require_utc
from seriesloom.operators.linear import score_linear
from seriesloom.operators.merge import upsert_table, with_month
from seriesloom.operators.validate import TARGET, prediction_records
from seriesloom.schema import FEATURES_KEY, PREDICTIONS_KEY, SERIES


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process what is there and stop. The checkpoint makes the next start continue from it, and
    the writers are idempotent, so a batch that runs twice changes nothing."""
    def once(batch: DataFrame, number: int) -> None:
        batch.persist()  # the upsert reads its batch several times
        try:
            write(batch, number)
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(once)
        .start()
    )
    query.awaitTermination()
    return query


def stream_score(
    spark: SparkSession,
    stream: DataFrame,
    models: DataFrame,
    thresholds: DataFrame,
    features: Sequence[str],
    label: str,
    out: str,
    checkpoint: str,
    update_date=None,
    accuracy_threshold: float = 85.0,
) -> DataFrame:
    """Score and validate each new row with its series' model and upsert the record.

    ``models`` and ``thresholds`` are tables with one row per series; each batch joins them afresh.
    """

    def write(batch: DataFrame, _: int) -> None:
        scored = score_linear(batch, models, TARGET, features, label, strict=True).withColumn(
            "real_value", F.col(label).cast("double")
        )
        records = prediction_records(
            scored, accuracy_threshold=accuracy_threshold, update_date=update_date, thresholds=thresholds
        )
        upsert_table(spark, out, with_month(records), PREDICTIONS_KEY, ["target_variable", "month"])

    run_available(stream, write, checkpoint)
    return spark.read.parquet(out).drop("month")


def stream_features(
    spark: SparkSession, observations: DataFrame, out: str, checkpoint: str, update_date=None, *, late: str
) -> DataFrame:
    """Hourly means per series from a stream of single observations.

    ``observations`` has (timestamp = hour, latitude, longitude, variable_code, value double or decimal). The state
    per (series, hour) is a sum and a count; each batch upserts the hours it changed, so the table equals the batch
    result and late rows correct their hour. ``late`` (e.g. "7 days") bounds the state: hours older than that
    are closed and rows that come later are left out.
    """
    require_utc()  # watermarks need a time with a zone
    observations = observations.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    means = (
        observations.groupBy("timestamp", *SERIES)
        .agg(F.sum("value").alias("_sum"), F.count("value").alias("_n"))
        .select(
            F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
            *SERIES,
            (F.col("_sum").cast("double") / F.col("_n")).alias("value"),
            F.lit(update_date).cast("timestamp_ntz").alias("update_date"),
        )
    )

    def write(batch: DataFrame, _: int) -> None:
        upsert_table(spark, out, with_month(batch), FEATURES_KEY, ["variable_code", "month"])

    run_available(means, write, checkpoint, mode="update")
    return spark.read.parquet(out).drop("month")

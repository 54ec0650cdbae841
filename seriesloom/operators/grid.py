"""Regular time axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.dates import epoch_micros, frequency_seconds, from_epoch_seconds
from seriesloom.operators.segments import SEGMENT, floor_div, segment_of


def complete_axis(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    order: str = "timestamp",
    step: str = "1h",
    width: str = "30D",
    bounds: DataFrame | None = None,
) -> DataFrame:
    """One row per series and step from the series' first to its last timestamp; missing cells null.

    ``bounds`` (keys, min_date, max_date) replaces the series' own first and last timestamp. The axis
    is unrolled segment by segment, so no row holds the whole axis. The rows and the axis meet in one
    shuffle on (series, segment); the result keeps that partitioning, and the segment column, for the
    window that follows.
    """
    keys = list(keys)
    step_s, width_s = frequency_seconds(step), frequency_seconds(width)
    if bounds is None:
        bounds = df.groupBy(*keys).agg(F.min(order).alias("min_date"), F.max(order).alias("max_date"))

    def seconds(name):
        return floor_div(epoch_micros(F.col(name)), 1_000_000)

    low = F.greatest(
        F.col("_a"), F.col("_a") + F.ceil((F.col(SEGMENT) * width_s - F.col("_a")) / step_s) * step_s
    )
    high = F.least(F.col("_z"), (F.col(SEGMENT) + 1) * width_s - 1)
    axis = (
        bounds.select(*keys, seconds("min_date").alias("_a"), seconds("max_date").alias("_z"))
        .withColumn(SEGMENT, F.explode(F.sequence(floor_div(F.col("_a"), width_s), floor_div(F.col("_z"), width_s))))
        .withColumns({"_low": low, "_high": high})
        .where(F.col("_low") <= F.col("_high"))
        .withColumn("_second", F.explode(F.sequence("_low", "_high", F.lit(step_s).cast("bigint"))))
        .select(
            *keys,
            SEGMENT,
            from_epoch_seconds(F.col("_second")).alias(order),
            F.lit(None).cast("double").alias(value),
        )
    )
    rows = df.select(*keys, segment_of(F.col(order), width).alias(SEGMENT), order, F.col(value).cast("double"))
    # The first row of each timestamp stays: an observed one if there is one. A window, not an
    # aggregation, because grouping by floating-point keys would hide the partitioning.
    by_time = Window.partitionBy(*keys, SEGMENT).orderBy(order, F.col(value).desc_nulls_last())
    return (
        axis.unionByName(rows)
        .withColumn("_before", F.lag(order).over(by_time))
        .where(F.col("_before").isNull() | (F.col("_before") != F.col(order)))
        .drop("_before")
    )

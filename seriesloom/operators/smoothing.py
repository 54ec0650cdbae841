"""Smoothing of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.numbers import clip
from seriesloom.operators.segments import (
    DEFAULT_BLOCK,
    POSITION,
    SERIES_ROWS,
    blocks_with_history,
    earlier,
    later,
    own_rows,
    with_positions,
)
from seriesloom.session import CODEC, materialize, materialize_alone


def rolling_mean(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    rows: int = 100,
    block: int = DEFAULT_BLOCK,
    keep_block: bool = False,
) -> DataFrame:
    """Trailing mean over ``rows`` rows, null until all of them have a value. Needs positions.

    Every window is summed afresh inside its block, so a NaN or a very large value spoils only the rows whose
    window holds it. ``keep_block`` keeps the block, in whose partitioning the rows are.
    """
    parts = blocks_with_history(df, rows - 1, block)
    trailing = Window.partitionBy(*keys, "_block").orderBy(POSITION).rowsBetween(1 - rows, Window.currentRow)
    mean = F.when(F.count(column).over(trailing) == rows, F.avg(column).over(trailing))
    means = parts.withColumn(column, mean)
    return means.where("_own").select(*df.columns, "_block") if keep_block else own_rows(means).select(*df.columns)


def smooth_predictions(
    df: DataFrame,
    keys: Sequence[str],
    column: str = "predictions",
    order: str = "timestamp",
    rows: int = 100,
    width: str = "30D",
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Clip at 0, trailing mean, then fill backward and forward, within each series.

    The rows are shuffled for their positions and for the blocks of the mean, in which they are filled too. They are
    stored in between and then; only rows after the last value of their block meet the table of blocks.
    """
    keys = list(keys)

    def in_blocks() -> DataFrame:
        placed = materialize(with_positions(df, keys, order, width), compression=CODEC)
        clipped = placed.withColumn(column, clip(F.col(column), 0))
        means = rolling_mean(clipped, keys, column, rows, block, keep_block=True)
        inside = Window.partitionBy(*keys, "_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        near = means.withColumn("_before", F.last(column, ignorenulls=True).over(inside.orderBy(POSITION)))
        near = near.withColumn(column, F.last(column, ignorenulls=True).over(inside.orderBy(F.col(POSITION).desc())))
        # The first and the last value of a block stand in its first and last row.
        size = F.lit(max(block, rows - 1)).cast("bigint")
        place = F.pmod(F.col(POSITION) - 1, size)
        last = (place == size - 1) | (F.col(POSITION) == F.col(SERIES_ROWS))
        return near.select(
            *df.columns,
            "_block",
            F.when(F.col(column).isNull(), F.col("_before")).alias("_before"),
            F.when(place == 0, F.col(column)).alias("_first"),
            F.when(last, F.coalesce(F.col(column), F.col("_before"))).alias("_last"),
        )

    near = materialize_alone(df.sparkSession, in_blocks)
    blocks = near.groupBy(*keys, "_block").agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    carry = blocks.select(
        *keys,
        "_block",
        F.last("_first", ignorenulls=True).over(later(keys, "_block")).alias("_after"),
        F.last("_last", ignorenulls=True).over(earlier(keys, "_block")).alias("_until"),
    )
    rest = near.where(F.col(column).isNull()).join(carry, [*keys, "_block"])
    rest = rest.withColumn(column, F.coalesce("_after", "_before", "_until"))
    return near.where(F.col(column).isNotNull()).select(*df.columns).unionByName(rest.select(*df.columns))

"""Landed array responses: one value array per variable over a regular axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.dates import from_epoch_seconds
from seriesloom.schema import LOCATION, SOURCE_VARIABLES, raw_hourly


def read_landed(spark: SparkSession, path: str, variables: Sequence[str] = SOURCE_VARIABLES) -> DataFrame:
    """JSON lines, one response each, with the declared schema (no inference pass)."""
    return spark.read.schema(raw_hourly(variables)).json(path)


def expand_hourly_arrays(df: DataFrame, variables: Sequence[str] = SOURCE_VARIABLES) -> DataFrame:
    """One row per step from start to end, end left out; an array that is too short gives nulls.

    Narrow: a response is unrolled in place.
    """
    steps = F.sequence("start_epoch", F.col("end_epoch") - F.col("interval_s"), F.col("interval_s").cast("bigint"))
    axis = F.when(F.col("end_epoch") - F.col("interval_s") >= F.col("start_epoch"), steps)
    return df.select(
        *LOCATION,
        F.inline(F.arrays_zip(axis.alias("epoch"), *[F.slice(v, F.lit(1), F.size(axis)).alias(v) for v in variables])),
    ).select(*LOCATION, from_epoch_seconds(F.col("epoch")).alias("timestamp"), *variables)

"""Forecast validation: accuracy, residual thresholds, flags, suggested values, records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.metrics import forecast_accuracy
from seriesloom.operators.quantiles import quartiles
from seriesloom.schema import LOCATION, PREDICTIONS

TARGET = [*LOCATION, "target_variable"]


def residual(real: Column, prediction: Column) -> Column:
    return real.cast("double") - prediction.cast("double")


def iqr_thresholds(
    df: DataFrame,
    keys: Sequence[str] = TARGET,
    threshold: float = 1.5,
    limits: DataFrame | None = None,
) -> DataFrame:
    """(keys, q1, q3, lower_threshold, upper_threshold) from each series' residuals.

    ``limits`` (keys, lower_limit, upper_limit) tightens the thresholds; missing limits do nothing.
    """
    keys = list(keys)
    res = df.select(*keys, residual(F.col("real_value"), F.col("predictions")).alias("_r"))
    q = quartiles(res, keys, "_r")
    low, high = F.col("q1") - threshold * F.col("iqr"), F.col("q3") + threshold * F.col("iqr")
    if limits is not None:
        q = q.join(limits.select(*keys, "lower_limit", "upper_limit"), keys, "left")
        low, high = F.greatest(low, "lower_limit"), F.least(high, "upper_limit")
    return q.select(*keys, "q1", "q3", low.alias("lower_threshold"), high.alias("upper_threshold"))


def validation_flag(res: Column, low: Column, high: Column, combine: str = "all") -> Column:
    """1 inside both thresholds; ``combine='any'`` accepts one of the two."""
    if combine not in ("all", "any"):
        raise ValueError("combine must be 'all' or 'any'")
    above, below = res >= low, res <= high
    return ((above & below) if combine == "all" else (above | below)).cast("int")


def suggested_value(
    real: Column, prediction: Column, flag: Column, accuracy: Column, accuracy_threshold: float
) -> Column:
    return F.when((flag == 1) & (accuracy >= accuracy_threshold), real).otherwise(prediction)


def validate(
    df: DataFrame,
    thresholds: DataFrame,
    accuracy_threshold: float = 85.0,
    keys: Sequence[str] = TARGET,
    combine: str = "all",
) -> DataFrame:
    """Add data_quality_percentage, validation_boolean and suggested_value."""
    real, pred = F.col("real_value").cast("double"), F.col("predictions").cast("double")
    flag = validation_flag(residual(real, pred), F.col("lower_threshold"), F.col("upper_threshold"), combine)
    return (
        df.join(thresholds.select(*keys, "lower_threshold", "upper_threshold"), list(keys), "left")
        .withColumns({"data_quality_percentage": forecast_accuracy(real, pred), "validation_boolean": flag})
        .withColumn(
            "suggested_value",
            suggested_value(
                real, pred, F.col("validation_boolean"), F.col("data_quality_percentage"), accuracy_threshold
            ),
        )
        .drop("lower_threshold", "upper_threshold")
    )


def own_thresholds(scored: DataFrame, validation_threshold: float = 1.5) -> DataFrame:
    """Thresholds from the residuals of each series, within the limits of its models."""
    limits = None
    if "lower_limit" in scored.columns:
        limits = scored.groupBy(*TARGET).agg(
            F.max("lower_limit").alias("lower_limit"), F.min("upper_limit").alias("upper_limit")
        )
    return iqr_thresholds(scored, TARGET, validation_threshold, limits)


def prediction_records(
    scored: DataFrame,
    validation_threshold: float = 1.5,
    accuracy_threshold: float = 85.0,
    update_date=None,
    thresholds: DataFrame | None = None,
    smoothed: str = "predictions",
) -> DataFrame:
    """Scored rows to rows of the predictions table.

    ``scored`` has the model identity, real_value and predictions. Thresholds come from its own
    residuals per series unless they are given (a stream passes the batch ones). The values of ``smoothed`` are
    recorded as predictions; all else is made from the predictions themselves.
    """
    if thresholds is None:
        thresholds = own_thresholds(scored, validation_threshold)
    checked = validate(scored, thresholds, accuracy_threshold)
    stamped = checked.withColumn("update_date", F.lit(update_date).cast("timestamp_ntz")).withColumn(
        "predictions", F.col(smoothed)
    )
    return stamped.select(*[F.col(f.name).cast(f.dataType) for f in PREDICTIONS.fields])

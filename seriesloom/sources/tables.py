"""Scans of the stored tables. Filters are plain predicates, so they reach the files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.schema import LOCATION, SERIES


def given(value) -> bool:
    return value not in (None, "", "None")


def in_range(df: DataFrame, start=None, end=None, end_inclusive_day: bool = False) -> DataFrame:
    """Both bounds included; ignored when either is missing.

    An upper bound without a time of day keeps only midnight of that day, unless
    ``end_inclusive_day`` is set.
    """
    if not (given(start) and given(end)):
        return df
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    ts = F.col("timestamp")
    if end_inclusive_day:
        next_day = (F.date_trunc("day", high) + F.make_dt_interval(F.lit(1))).cast("timestamp_ntz")
        return df.where((ts >= low) & (ts < next_day))
    return df.where(ts.between(low, high))


def at_location(df: DataFrame, latitude=None, longitude=None, locations: DataFrame | None = None) -> DataFrame:
    """One location by its coordinates to three decimals, or many by a table of (latitude, longitude).

    Stored coordinates may come from single precision or from text, so equality is that of rounded values; as a range
    it still reaches the files.
    """
    if locations is not None:
        return df.join(locations.select(*LOCATION).distinct(), LOCATION, "left_semi")
    for name, value in (("latitude", latitude), ("longitude", longitude)):
        if value is not None:
            middle = round(float(value), 3)
            df = df.where((F.col(name) >= middle - 0.0005) & (F.col(name) < middle + 0.0005))
    return df


def feature_scan(
    df: DataFrame,
    latitude=None,
    longitude=None,
    start=None,
    end=None,
    variables: str | Sequence[str] | None = None,
    locations: DataFrame | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Location, time range and unanchored variable patterns, ordered by location and time.

    On a table partitioned by variable_code the pattern is a partition filter.
    """
    out = in_range(at_location(df, latitude, longitude, locations), start, end)
    if variables:
        pattern = variables if isinstance(variables, str) else "|".join(variables)
        out = out.where(F.col("variable_code").rlike(pattern))
    return out.orderBy(*LOCATION, "timestamp", "variable_code") if ordered else out


def predictions_scan(
    df: DataFrame,
    latitude=None,
    longitude=None,
    start=None,
    end=None,
    targets: str | Sequence[str] | None = None,
    locations: DataFrame | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Time range, or each location's latest timestamp when a bound is missing; newest first."""
    out = at_location(df, latitude, longitude, locations)
    if targets:
        out = out.where(F.col("target_variable").isin([targets] if isinstance(targets, str) else list(targets)))
    if given(start) and given(end):
        out = in_range(out, start, end)
    else:
        latest = out.groupBy(*LOCATION).agg(F.max("timestamp").alias("timestamp"))
        out = out.join(latest, [*LOCATION, "timestamp"], "left_semi")
    return out.orderBy(F.col("timestamp").desc(), *LOCATION, "target_variable") if ordered else out


def config_scan(df: DataFrame, effective: Column, stage: str | None = None) -> DataFrame:
    out = df.where(F.col("timestamp") == effective)
    if stage:
        out = out.where(F.col("stage") == stage)
    return out.orderBy("created_date", "stage", "parameter_code")


def registry_scan(
    df: DataFrame,
    model_name: str,
    model_type: str,
    target: str,
    latitude=None,
    longitude=None,
    model_date: Column | None = None,
    columns: Sequence[str] = (),
) -> DataFrame:
    """Models of one identity; the target is a pattern, the date counts within one second."""
    out = at_location(df, latitude, longitude).where(
        (F.col("model_name") == model_name)
        & (F.col("model_type") == model_type)
        & F.col("target_variable").rlike(target)
    )
    if model_date is not None:
        second = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1))
        out = out.where(F.col("model_date").between(model_date - second, model_date + second))
    out = out.orderBy("target_variable", "model_version", "model_date")
    return out.select(*columns) if columns else out


def registry_importances(df: DataFrame) -> DataFrame:
    """One row per model and feature."""
    return df.select(
        "model_date", "model_name", "model_type", *LOCATION, "target_variable", "model_version",
        F.explode("feature_importances").alias("feature", "importance"),
    )


def distinct_coordinates(df: DataFrame) -> DataFrame:
    return df.select(*LOCATION).distinct()


def partner_coordinate(df: DataFrame, latitude=None, longitude=None) -> DataFrame:
    """The smallest longitude of a latitude, or the other way round."""
    here = at_location(df, latitude, longitude)
    known, other = ("latitude", "longitude") if latitude is not None else ("longitude", "latitude")
    return here.groupBy(known).agg(F.min(other).alias(other))


def distinct_variables(df: DataFrame) -> DataFrame:
    return df.select("variable_code").distinct()


def target_variable(df: DataFrame, part: str = "precipitation") -> DataFrame:
    """The first variable, by name, that contains the text."""
    return df.where(F.col("variable_code").contains(part)).agg(F.min("variable_code").alias("target_variable"))


def date_bounds(df: DataFrame, keys: Sequence[str] = LOCATION) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("timestamp").alias("min_date"), F.max("timestamp").alias("max_date"))


def last_processed(locations: DataFrame, marks: DataFrame, data_type: str) -> DataFrame:
    """Every location with its mark; null when it has none."""
    own = marks.where(F.col("data_type") == data_type).select(*LOCATION, "timestamp")
    return locations.select(*LOCATION).distinct().join(own, LOCATION, "left")


def models_of_config(df: DataFrame, effective, model_id) -> DataFrame:
    """Configuration rows of a date and model; empty unless both are given."""
    if not (given(effective) and given(model_id)):
        return df.limit(0)
    return df.where((F.col("timestamp") == F.lit(effective).cast("timestamp_ntz")) & (F.col("model_id") == model_id))


def series_of(df: DataFrame) -> DataFrame:
    return df.select(*SERIES).distinct()

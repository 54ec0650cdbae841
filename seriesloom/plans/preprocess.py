"""Observations to the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.calendar import DEFAULT_FEATURES, FEATURES, with_calendar
from seriesloom.functions.dates import epoch_micros, frequency_seconds, resolve_preprocess_range
from seriesloom.operators.grid import complete_axis
from seriesloom.operators.impute import interpolate_time
from seriesloom.operators.segments import floor_div, suggest_width
from seriesloom.schema import LOCATION, SERIES
from seriesloom.session import materialize, scratch_scope
from seriesloom.sources.landed import expand_hourly_arrays
from seriesloom.sources.sinks import long_features, save_features


def preprocess_wide(wide: DataFrame, variables: Sequence[str], width: str = "30D") -> DataFrame:
    """Gaps interpolated per location, calendar features added."""
    filled = interpolate_time(wide, LOCATION, list(variables), width=width)
    return with_calendar(filled)


def preprocess_landed(responses: DataFrame, variables: Sequence[str], update_date, width: str = "30D") -> DataFrame:
    """Landed array responses to long features."""
    wide = preprocess_wide(expand_hourly_arrays(responses, variables), variables, width)
    return long_features(wide, [*variables, *DEFAULT_FEATURES], update_date)


def preprocess_observations(
    obs: DataFrame, update_date, step: str = "1h", width: str = "30D", bounds: DataFrame | None = None
) -> DataFrame:
    """Long observations of any series to long features: axis, interpolation, calendar variables.

    Values stay long, so the number of variables does not widen the rows. Calendar variables are made
    once per (location, timestamp).
    """
    full = complete_axis(obs, SERIES, step=step, width=width, bounds=bounds)
    filled = interpolate_time(full, SERIES, ["value"], width=width)
    stamp = F.lit(update_date).cast("timestamp_ntz")
    values = filled.select("timestamp", *LOCATION, "variable_code", "value", stamp.alias("update_date"))
    # One axis per location: all its series share the same steps, so the bounds make it; only observations
    # off the steps add to it.
    if bounds is None:
        spans = obs.groupBy(*LOCATION).agg(F.min("timestamp").alias("min_date"), F.max("timestamp").alias("max_date"))
    else:
        spans = bounds.groupBy(*LOCATION).agg(F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"))
    apart = epoch_micros(F.col("timestamp")) - floor_div(epoch_micros(F.col("min_date")), 1_000_000) * 1_000_000
    off = obs.join(spans, LOCATION).where(F.pmod(apart, F.lit(frequency_seconds(step) * 1_000_000)) != 0)
    off = off.select(*LOCATION, "timestamp", F.lit(None).cast("double").alias("value")).distinct()
    axis = complete_axis(off, LOCATION, step=step, width=width, bounds=spans)
    codes = F.array(
        *[
            F.struct(F.lit(f).alias("variable_code"), FEATURES[f](F.col("timestamp")).cast("double").alias("value"))
            for f in DEFAULT_FEATURES
        ]
    )
    calendar = axis.select("timestamp", *LOCATION, F.inline(codes)).withColumn("update_date", stamp)
    return values.unionByName(calendar)


def with_last_known(obs: DataFrame, marks: DataFrame, data_type: str = "engineered_data") -> DataFrame:
    """Observations newer than their location's mark, and each series' last one up to it, however old."""
    known = marks.where(F.col("data_type") == data_type).select(*LOCATION, F.col("timestamp").alias("_mark"))
    marked = obs.join(known, LOCATION, "left")
    old = marked.where((F.col("timestamp") <= F.col("_mark")) & F.col("value").isNotNull())
    last = old.groupBy(*SERIES).agg(F.max("timestamp").alias("_last"))
    return (
        marked.join(last, SERIES, "left")
        .where(F.col("_mark").isNull() | (F.col("timestamp") > F.col("_mark")) | (F.col("timestamp") >= F.col("_last")))
        .drop("_mark", "_last")
    )


def run_preprocess(
    spark: SparkSession,
    root: str,
    obs: DataFrame,
    update_date,
    marks: DataFrame | None = None,
    step: str = "1h",
    look_back: tuple[int, str, str] | None = None,
    now=None,
) -> None:
    """Process what is newer than the marks (everything without marks) and save it.

    With marks, each series starts from its last observation up to the mark, however old,
    so the hours between that and the first new observation are filled as a full run fills them.
    ``look_back`` (steps, frequency, direction) shifts the marks, and ``now`` (the update date by default) ends the run.
    """
    with scratch_scope(spark):
        if look_back is not None and marks is not None:
            end = F.lit(now or update_date).cast("timestamp_ntz")
            window, frequency, direction = look_back
            marks = resolve_preprocess_range(marks, end, window, direction, frequency).withColumn("timestamp", F.col("start_date"))
            obs = obs.where(F.col("timestamp") <= end)
        fresh = materialize(obs if marks is None else with_last_known(obs, marks))
        # The completed axis has one row per step, or the observed rows where they are denser.
        steps = max(60, frequency_seconds(step) * 50_000 // 60)
        width = min(suggest_width(fresh, SERIES, "timestamp"), f"{steps}min", key=frequency_seconds)
        save_features(spark, root, preprocess_observations(fresh, update_date, step, width), update_date)


def trailing_days(df: DataFrame, end, days: int = 7) -> DataFrame:
    """Rows of the last ``days`` up to ``end``: the input of the daily, repeatable re-run."""
    stop = F.lit(end).cast("timestamp_ntz")
    return df.where((F.col("timestamp") >= stop - F.make_dt_interval(F.lit(days))) & (F.col("timestamp") <= stop))


def rolling_week_rerun(spark: SparkSession, root: str, obs: DataFrame, end, update_date, days: int = 7) -> None:
    run_preprocess(spark, root, trailing_days(obs, end, days), update_date)

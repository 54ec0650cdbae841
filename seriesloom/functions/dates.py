"""Date shifts and default ranges over many series at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.schema import LOCATION

# Seconds per unit of a frequency text, with the spellings pandas accepts.
UNIT_SECONDS = {
    "w": 604800, "d": 86400, "day": 86400, "days": 86400,
    "h": 3600, "hr": 3600, "hour": 3600, "hours": 3600,
    "m": 60, "min": 60, "minute": 60, "minutes": 60, "t": 60,
    "s": 1, "sec": 1, "second": 1, "seconds": 1,
}

FREQUENCY = re.compile(r"(?P<number>[0-9]*)\s*(?P<unit>[A-Za-z]+)")


def frequency_seconds(frequency: str) -> int:
    """Seconds in a frequency such as ``15min`` or ``1D``; a missing number means 1."""
    m = FREQUENCY.fullmatch(frequency.strip())
    seconds = UNIT_SECONDS.get(m["unit"].lower()) if m else None
    if seconds is None:
        raise ValueError(f"not a number and a time unit: {frequency!r}")
    return int(m["number"] or 1) * seconds


def require_utc() -> None:
    """Naive times become instants in the session's zone; any other zone than UTC would shift them."""
    session = SparkSession.getActiveSession()
    zone = session.conf.get("spark.sql.session.timeZone") if session else "UTC"
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise RuntimeError(f"spark.sql.session.timeZone must be UTC, not {zone}")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a naive time."""
    require_utc()
    return F.unix_micros(ts.cast("timestamp"))


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def interval_seconds(seconds) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def hour_of(ts: Column) -> Column:
    """Start of the hour, kept without a time zone."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def day_of(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def shift_date(ts: Column, window: int, direction: str, frequency: str) -> Column:
    """Move by window x frequency and keep only the date."""
    if direction not in ("forward", "backward"):
        raise ValueError("direction must be 'forward' or 'backward'")
    seconds = window * frequency_seconds(frequency)
    return day_of(ts + interval_seconds(seconds if direction == "forward" else -seconds))


def within(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows from their location's start_date to its end_date. The widest range is a literal filter, so it reaches the scan."""
    widest = ranges.agg(F.min("start_date"), F.max("end_date")).first()
    near = df.where(F.col("timestamp").between(*[F.lit(bound).cast("timestamp_ntz") for bound in widest]))
    limits = ranges.select(*LOCATION, "start_date", "end_date")
    inside = F.col("timestamp").between(F.col("start_date"), F.col("end_date"))
    return near.join(limits, LOCATION).where(inside).select(*df.columns)


def resolve_preprocess_range(
    marks: DataFrame, now: Column, window: int = 100, direction: str = "backward", frequency: str = "1D"
) -> DataFrame:
    """Start at the high-water mark (else now) shifted back, end now; one row per location."""
    start = shift_date(F.coalesce(F.col("timestamp"), now), window, direction, frequency)
    return marks.withColumns({"start_date": start, "end_date": now})


def resolve_training_range(bounds: DataFrame, start: Column | None = None, end: Column | None = None):
    """Given bounds win; the rest comes from each location's first and last timestamp."""
    return bounds.select(
        *LOCATION,
        (F.col("min_date") if start is None else F.coalesce(start, "min_date")).alias("start_date"),
        (F.col("max_date") if end is None else F.coalesce(end, "max_date")).alias("end_date"),
    )


def resolve_prediction_range(
    feature_marks: DataFrame,
    prediction_marks: DataFrame,
    window: int,
    frequency: str,
    direction: str = "backward",
) -> DataFrame:
    """Start at the prediction mark, else at the feature mark shifted; end at the feature mark.

    Ranges of three steps or fewer are widened by four steps at the start. A location that has
    predictions but no feature mark fails the job.
    """
    step = frequency_seconds(frequency)
    features = feature_marks.select(*LOCATION, F.col("timestamp").alias("feature_mark"))
    predictions = prediction_marks.select(*LOCATION, F.col("timestamp").alias("prediction_mark"))
    end = F.when(
        F.col("feature_mark").isNull(),
        F.raise_error(F.lit("no high-water mark of features for a location")).cast("timestamp_ntz"),
    ).otherwise(F.col("feature_mark"))
    shifted = shift_date(F.col("feature_mark"), window, direction, frequency)
    start = F.coalesce("prediction_mark", shifted)
    short = epoch_micros(F.col("end_date")) - epoch_micros(F.col("start_date")) <= 3 * step * 1_000_000
    return (
        features.join(predictions, LOCATION, "full")
        .select(*LOCATION, start.alias("start_date"), end.alias("end_date"))
        .withColumn(
            "start_date",
            F.when(short, F.col("start_date") - interval_seconds(4 * step)).otherwise(F.col("start_date")),
        )
    )

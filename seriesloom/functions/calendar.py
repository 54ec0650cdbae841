"""Calendar features as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First and last day (month * 100 + day, both included) and code of each season.
# Winter is everything else and has code 0.
SEASONS = [(321, 620, 1), (621, 922, 2), (923, 1220, 3)]


def season(ts: Column) -> Column:
    month_day = F.month(ts) * 100 + F.dayofmonth(ts)
    code = F.when(month_day.isNull(), F.lit(None).cast("int"))
    for first, last, value in SEASONS:
        code = code.when(month_day.between(first, last), value)
    return code.otherwise(0)


FEATURES: dict[str, Callable[[Column], Column]] = {
    "hour": F.hour,
    "month": F.month,
    "weekday": F.weekday,  # Monday is 0
    "year_season": season,
    "day_of_month": F.dayofmonth,
}
DEFAULT_FEATURES = ["hour", "month", "weekday", "year_season"]


def with_calendar(
    df: DataFrame, ts: str = "timestamp", features: Sequence[str] = DEFAULT_FEATURES
) -> DataFrame:
    unknown = [f for f in features if f not in FEATURES]
    if unknown:
        raise ValueError(f"unknown calendar features: {unknown}")
    return df.withColumns({f: FEATURES[f](F.col(ts)) for f in features})

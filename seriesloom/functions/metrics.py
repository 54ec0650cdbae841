"""Metrics by name, as aggregate expressions over (actual, prediction) columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10  # fixed value: added to the denominator of the percentage error
PROBABILITY_FLOOR = 1e-15  # fixed value: probabilities are clipped to [floor, 1 - floor]


def _mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def _rmspe(y: Column, p: Column) -> Column:
    ratio = (y - p) / (y + EPSILON)
    return 100 * F.sqrt(F.avg(ratio * ratio))


def _r2(y: Column, p: Column) -> Column:
    pair = y.isNotNull() & p.isNotNull()
    spread = F.var_pop(F.when(pair, y)) * F.count(F.when(pair, 1))
    return 1 - F.try_divide(F.sum((y - p) * (y - p)), spread)


REGRESSION: dict[str, Callable[[Column, Column], Column]] = {
    "mean_squared_error": _mse,
    "root_mean_squared_error": lambda y, p: F.sqrt(_mse(y, p)),
    "root_mean_squared_percentage_error": _rmspe,
    "mean_absolute_error": lambda y, p: F.avg(F.abs(y - p)),
    "r2": _r2,
}
# Metrics for which a larger value is the better one.
LARGER_IS_BETTER = {"r2", "accuracy", "balanced_accuracy", "f1_score"}


def regression_metric(name: str, y: Column, p: Column) -> Column:
    if name not in REGRESSION:
        raise NotImplementedError(f"unknown regression metric {name!r}")
    return REGRESSION[name](y.cast("double"), p.cast("double"))


def regression_metrics(y: Column, p: Column, names: Iterable[str] = tuple(REGRESSION)) -> list[Column]:
    """All requested metrics for one ``agg`` call, so one pass over the rows."""
    return [regression_metric(n, y, p).alias(n) for n in names]


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def log_loss(y: Column, probability: Column) -> Column:
    clipped = F.when(
        probability.isNotNull(),
        F.greatest(F.lit(PROBABILITY_FLOOR), F.least(F.lit(1 - PROBABILITY_FLOOR), probability)),
    )
    return -F.avg(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))


def forecast_accuracy(real: Column, prediction: Column, abs_denominator: bool = False) -> Column:
    """(1 - |prediction - real| / real) * 100 in [0, 100].

    The denominator is signed, so a negative actual gives 100. A zero actual gives 0, and null when
    the prediction is zero too.
    """
    base = F.abs(real) if abs_denominator else real
    ratio = (1 - F.try_divide(F.abs(prediction - real), base)) * 100
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), ratio))
    return (
        F.when(real.isNull() | prediction.isNull(), None)
        .when(real == 0, F.when(prediction != 0, 0.0))
        .otherwise(clipped)
    )


def mean_forecast_accuracy(real: Column, prediction: Column, zero_actual: str = "skip") -> Column:
    """Mean of the unclipped row accuracies, then clipped to [0, 100].

    ``zero_actual='skip'`` leaves rows with a zero actual out; ``'floor'`` makes the result 0 as
    soon as one of them has a prediction other than zero.
    """
    if zero_actual not in ("skip", "floor"):
        raise ValueError("zero_actual must be 'skip' or 'floor'")
    row = (1 - F.try_divide(F.abs(prediction - real), real)) * 100
    mean = F.avg(row)
    clipped = F.when(mean.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean)))
    if zero_actual == "floor":
        missed = F.coalesce(F.bool_or((real == 0) & (prediction != 0)), F.lit(False))
        return F.when(missed, 0.0).otherwise(clipped)
    return clipped


def zero_actuals(real: Column) -> Column:
    return F.count_if(real == 0)

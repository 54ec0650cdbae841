"""Lag features and the choice of lags by partial autocorrelation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.numbers import round_half_even
from seriesloom.operators.impute import complete_rows, interpolate_linear
from seriesloom.operators.segments import (
    DEFAULT_BLOCK,
    POSITION,
    SERIES_ROWS,
    blocks_with_history,
    own_rows,
    with_positions,
)

THRESHOLD = 0.2  # fixed value: a lag is kept when |partial autocorrelation| reaches it
MAX_LAG = 50  # fixed value


def add_lags(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    lags: Sequence[int],
    prefix: str = "lag_",
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Add ``lag_k`` columns by row position. Needs positions."""
    if not lags:
        return df
    parts = blocks_with_history(df, max(lags), block)
    order = Window.partitionBy(*keys, "_block").orderBy(POSITION)
    named = {f"{prefix}{k}": F.lag(column, k).over(order) for k in lags}
    return own_rows(parts.withColumns(named))


def lag_features(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    lags: Sequence[int],
    order: str = "timestamp",
    width: str = "30D",
    digits: int | None = 2,
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Lag columns without the incomplete first rows, rounded half to even."""
    placed = with_positions(df, keys, order, width)
    lagged = complete_rows(add_lags(placed, keys, column, lags, block=block), [f"lag_{k}" for k in lags])
    if digits is not None:
        lagged = lagged.withColumns({f"lag_{k}": round_half_even(F.col(f"lag_{k}"), digits) for k in lags})
    return lagged.drop(POSITION, SERIES_ROWS)


def autocovariances(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    nlags: int = MAX_LAG,
    order: str = "timestamp",
    width: str = "30D",
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Per series: n, the usable number of lags min(nlags, n // 2 - 1), and the autocovariances of
    lag 0..nlags with denominators n - k. Sums combine on the map side."""
    keys = list(keys)
    placed = with_positions(df, keys, order, width)
    means = df.groupBy(*keys).agg(F.avg(column).alias("_mean"))
    # Lag products only need rows near each other, so the centred values travel in blocks.
    centred = placed.join(means, keys).withColumn("_x", F.col(column) - F.col("_mean"))
    centred = centred.select(*keys, POSITION, SERIES_ROWS, "_x")
    lagged = add_lags(centred, keys, "_x", range(1, nlags + 1), "_x", block)
    n = F.max(SERIES_ROWS)
    products = [F.sum(F.col("_x") * F.col(f"_x{k}" if k else "_x")).alias(f"_s{k}") for k in range(nlags + 1)]
    sums = lagged.groupBy(*keys).agg(n.alias("n"), *products)
    usable = F.greatest(F.lit(0), F.least(F.lit(nlags), F.floor(F.col("n") / 2) - 1)).cast("int")
    gamma = F.array(*[F.try_divide(F.col(f"_s{k}"), F.col("n") - k) for k in range(nlags + 1)])
    return sums.select(*keys, "n", usable.alias("n_lags"), gamma.alias("autocovariance"))


def durbin_levinson(gamma: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of lag 0..m from the autocovariances; all zero when singular."""
    m = len(gamma) - 1
    out = np.zeros(m + 1)
    if m < 0 or not np.all(np.isfinite(gamma)) or gamma[0] <= 0:
        return out
    out[0] = 1.0
    phi, error = np.zeros(0), gamma[0]
    for k in range(1, m + 1):
        if abs(error) <= 1e-14 * gamma[0]:
            return np.zeros(m + 1)
        last = (gamma[k] - phi @ gamma[k - 1 : 0 : -1]) / error
        phi = np.append(phi - last * phi[::-1], last)
        error *= 1 - last * last
        out[k] = last
    return out


def _partial(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for gamma, usable in batches:
        yield pd.Series([durbin_levinson(np.asarray(g, float)[: m + 1]) for g, m in zip(gamma, usable)])


def partial_autocorrelation(df: DataFrame, keys: Sequence[str], column: str, **options) -> DataFrame:
    """One row per series; the only Python is the solve over at most ``nlags + 1`` numbers."""
    cov = autocovariances(df, keys, column, **options)
    solve = F.pandas_udf(_partial, "array<double>")
    return cov.withColumn("pacf", solve("autocovariance", "n_lags"))


def select_lags(
    df: DataFrame, keys: Sequence[str], column: str, threshold: float = THRESHOLD, **options
) -> DataFrame:
    """Lags >= 1 whose partial autocorrelation reaches the threshold, one row per series."""
    partial = partial_autocorrelation(df, keys, column, **options)
    lags = F.filter(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("pacf") - 1)),
        lambda k: (k < F.size("pacf")) & (F.abs(F.get("pacf", k)) >= threshold),
    )
    return partial.select(*keys, "n", "n_lags", "pacf", lags.alias("lags"))


def supervised_lags(
    df: DataFrame, keys: Sequence[str], column: str, nlags: int = MAX_LAG, order: str = "timestamp", width: str = "30D"
) -> DataFrame:
    """Fill, choose lags per series, and give each series its own lags as a map column.

    Rows that miss one of their series' own lags are dropped.
    """
    keys = list(keys)
    filled = interpolate_linear(df, keys, [column], order, width, edges=True)
    chosen = select_lags(filled, keys, column, nlags=nlags, order=order, width=width).select(*keys, "lags")
    placed = with_positions(filled, keys, order, width)
    lagged = add_lags(placed, keys, column, range(1, nlags + 1), "_x")
    values = F.array(*[round_half_even(F.col(f"_x{k}"), 2) for k in range(1, nlags + 1)])
    return (
        lagged.join(chosen, keys)
        .where(F.col(POSITION) > F.coalesce(F.array_max("lags"), F.lit(0)))
        .withColumn(
            "lag_values", F.transform("lags", lambda k: F.get(values, (k - 1).cast("int")))
        )
        .select(*df.columns, "lags", "lag_values")
    )

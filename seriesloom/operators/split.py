"""Chronological splits and expanding-window folds by exact row position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.segments import POSITION, SERIES_ROWS, with_positions


def rows_in_test(n: Column, test_size: float) -> Column:
    return F.ceil(n * F.lit(float(test_size))).cast("bigint")


def train_test_split(
    df: DataFrame,
    keys: Sequence[str],
    test_size: float = 0.1,
    order: str = "timestamp",
    width: str = "30D",
    keep_positions: bool = False,
) -> DataFrame:
    """Add ``split``: the last ceil(n * test_size) rows of each series are 'test'."""
    placed = df if POSITION in df.columns else with_positions(df, keys, order, width)
    n = F.col(SERIES_ROWS)
    is_test = F.col(POSITION) > n - rows_in_test(n, test_size)
    out = placed.withColumn("split", F.when(is_test, "test").otherwise("train"))
    return out if keep_positions else out.drop(POSITION, SERIES_ROWS)


def fold_block(n_splits: int, position: Column, n: Column) -> Column:
    """0 for rows before the first test block, f + 1 for rows in test block f.

    The training rows of fold f are exactly the rows with block <= f, so folds need no copies.
    """
    if n_splits < 2:
        raise ValueError("at least 2 folds")
    size = F.floor(n / (n_splits + 1))
    start = n - size * n_splits
    block = F.floor((position - 1 - start) / F.when(size > 0, size)) + 1
    return F.greatest(F.lit(0), block).cast("int")


def with_fold_block(
    df: DataFrame, keys: Sequence[str], n_splits: int, order: str = "timestamp", width: str = "30D"
) -> DataFrame:
    placed = df if POSITION in df.columns else with_positions(df, keys, order, width)
    return placed.withColumn("fold_block", fold_block(n_splits, F.col(POSITION), F.col(SERIES_ROWS)))


def time_series_folds(
    df: DataFrame, keys: Sequence[str], n_splits: int, order: str = "timestamp", width: str = "30D"
) -> DataFrame:
    """One row per fold a row belongs to, with ``fold`` and ``role`` ('train' or 'test')."""
    blocked = with_fold_block(df, keys, n_splits, order, width)
    first = F.greatest(F.col("fold_block") - 1, F.lit(0))
    return (
        blocked.withColumn("fold", F.explode(F.sequence(first, F.lit(n_splits - 1))))
        .withColumn("role", F.when(F.col("fold_block") == F.col("fold") + 1, "test").otherwise("train"))
        .drop(POSITION, SERIES_ROWS, "fold_block")
    )

"""Gap filling, exact across segments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.dates import epoch_micros
from seriesloom.operators.segments import (
    DEFAULT_WIDTH,
    POSITION,
    with_neighbours,
    with_positions,
)


def _line(c: str, here: Column, axis) -> Column:
    """Straight line between the neighbours; null before the first value, flat after the last."""
    prev, following = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
    before, after = axis(prev["x"]), axis(following["x"])
    slope = (following["v"] - prev["v"]) * (here - before).cast("double") / (after - before).cast("double")
    return (
        F.when(F.col(c).isNotNull(), F.col(c))
        .when(prev.isNull(), F.lit(None))
        .when(following.isNull(), prev["v"])
        .otherwise(prev["v"] + slope)
    )


def _prev(c: str) -> Column:
    return F.col(f"_prev_{c}")["v"]


def _next(c: str) -> Column:
    return F.col(f"_next_{c}")["v"]


def interpolate_time(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order: str = "timestamp",
    width: str = DEFAULT_WIDTH,
) -> DataFrame:
    near = with_neighbours(df, keys, order, columns, width)
    filled = {c: _line(c, epoch_micros(F.col(order)), epoch_micros) for c in columns}
    return near.withColumns(filled).select(*df.columns)


def interpolate_linear(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order: str = "timestamp",
    width: str = DEFAULT_WIDTH,
    edges: bool = False,
) -> DataFrame:
    """Rows count as equally spaced. ``edges`` also fills leading gaps backward."""
    placed = with_positions(df, keys, order, width, keep_segment=True)
    near = with_neighbours(placed, keys, POSITION, columns)
    line = {c: _line(c, F.col(POSITION), lambda x: x) for c in columns}
    if edges:
        line = {c: F.coalesce(v, _next(c)) for c, v in line.items()}
    return near.withColumns(line).select(*df.columns)


def forward_fill(df, keys, columns, order="timestamp", width=DEFAULT_WIDTH) -> DataFrame:
    near = with_neighbours(df, keys, order, columns, width)
    return near.withColumns({c: _prev(c) for c in columns}).select(*df.columns)


def backward_fill(df, keys, columns, order="timestamp", width=DEFAULT_WIDTH) -> DataFrame:
    near = with_neighbours(df, keys, order, columns, width)
    return near.withColumns({c: _next(c) for c in columns}).select(*df.columns)


def fill_both(df, keys, columns, order="timestamp", width=DEFAULT_WIDTH) -> DataFrame:
    """Backward fill, then forward fill, in one pass over the rows."""
    near = with_neighbours(df, keys, order, columns, width)
    return near.withColumns({c: F.coalesce(_next(c), _prev(c)) for c in columns}).select(*df.columns)


def fill_chain(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order: str = "timestamp",
    width: str = DEFAULT_WIDTH,
    constant: float = 0.0,
) -> DataFrame:
    """Time interpolation, backward fill, forward fill, constant: one pass, since all four steps
    only need each row's neighbours."""
    near = with_neighbours(df, keys, order, columns, width)
    filled = {
        c: F.coalesce(_line(c, epoch_micros(F.col(order)), epoch_micros), _next(c), F.lit(constant))
        for c in columns
    }
    return near.withColumns(filled).select(*df.columns)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row with the number of nulls of each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in (columns or df.columns)])


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in the columns, as one plain condition per column."""
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in columns])) if columns else df


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.na.drop(how=how, subset=list(columns) if columns else None)

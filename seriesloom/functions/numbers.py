"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low=None, high=None) -> Column:
    """Clip and keep nulls (``greatest`` and ``least`` would replace them by the bound)."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low).cast("double"))
    if high is not None:
        out = F.least(out, F.lit(high).cast("double"))
    return F.when(value.isNotNull(), out)


def round_half_even(value: Column, digits: int) -> Column:
    """Scaled to the nearest even integer and back, as array libraries do. ``bround`` works on the
    decimal text of a double instead and differs where scaling lands on a tie."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale

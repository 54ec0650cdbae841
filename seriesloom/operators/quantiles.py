"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Ranges of values that a bracket is counted in.
SLICES = 64


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], column: str, probabilities: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """(keys, n, probability, quantile) with linear interpolation between order statistics.

    The built-in exact percentile keeps every distinct value of a group in one task. Here a sketch
    with a known rank error brackets each quantile, and one map-side combined count gives the exact ranks of
    the bracket's ``SLICES`` ranges of values. Only the values of the range that holds the rank are ordered.
    Rows with null keys are groups of their own.
    """
    names = list(keys)
    keys = ["_group"]  # a struct of nulls equals itself in joins, a null does not
    rows = df.select(F.struct(*names).alias("_group"), F.col(column).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    # The bracket must reach both order statistics: the sketch is off by a share of 1 / accuracy at most, and
    # they lie within three ranks of p * n. So it is the tightest share s with s * n >= n / accuracy + 3.
    shares = [2.0 * 4**k / accuracy for k in range(20) if 2.0 * 4**k < accuracy]
    edges = [min(1.0, max(0.0, p + side * share)) for p in probabilities for share in shares for side in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.percentile_approx("_v", edges, accuracy).alias("_edges"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )

    def edge(i: int, side: int):
        """The tightest edge that is safe for n rows; an edge at rank 0 or 1 is the extreme itself."""
        extreme = F.col("_max" if side else "_min")
        out = None
        for j, share in enumerate(shares):
            k = 2 * (i * len(shares) + j) + side
            value = extreme if edges[k] in (0.0, 1.0) else F.get("_edges", F.lit(k))
            wide = F.lit(share - 1.0 / accuracy) * F.col("n") >= 3
            out = F.when(wide, value) if out is None else out.when(wide, value)
        return out.otherwise(extreme)

    brackets = F.array(
        *[
            F.struct(F.lit(float(p)).alias("probability"), edge(i, 0).alias("low"), edge(i, 1).alias("high"))
            for i, p in enumerate(probabilities)
        ]
    )
    low, high = F.col("_b.low"), F.col("_b.high")
    slice_of = F.when(
        F.col("_v").isNotNull(),
        F.when(high > low, F.floor((F.col("_v") - low) / (high - low) * SLICES)).otherwise(0).cast("int"),
    )
    bracketed = sketch.select(*keys, "n", brackets.alias("_brackets"))
    # Rows below a bracket count as one null value in range -1, rows above it are not needed.
    placed = (
        rows.join(bracketed, keys)
        .select(*keys, "n", "_v", F.explode("_brackets").alias("_b"))
        .where(F.col("_v") <= F.col("_b.high"))
        .withColumn("_v", F.when(F.col("_v") >= F.col("_b.low"), F.col("_v")))
        .withColumn("_slice", F.coalesce(slice_of, F.lit(-1)))
        .select(*keys, "n", F.col("_b.probability").alias("probability"), "_slice", "_v")
    )
    counts = placed.groupBy(*keys, "probability", "_slice", "_v").agg(F.count("*").alias("_c"), F.first("n").alias("n"))
    place = (F.col("n") - 1) * F.col("probability")
    lower = F.floor(place) + 1
    upper = F.least(F.floor(place) + 2, F.col("n"))
    ranges = counts.groupBy(*keys, "probability", "_slice").agg(F.sum("_c").alias("_rows"), F.first("n").alias("n"))
    in_order = Window.partitionBy(*keys, "probability").orderBy("_slice")  # at most SLICES + 2 rows
    before = F.coalesce(F.sum("_rows").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = (
        ranges.withColumn("_before", before)
        .where((F.col("_slice") >= 0) & (F.col("_before") < upper) & (F.col("_before") + F.col("_rows") >= lower))
        .select(*keys, "probability", "_slice", "_before")
    )
    upto = Window.partitionBy(*keys, "probability", "_slice").orderBy("_v")
    running = F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.join(wanted, [*keys, "probability", "_slice"]).withColumn("_rank", F.col("_before") + running)
    stats = ranked.groupBy(*keys, "probability", "n").agg(
        F.min(F.when(F.col("_rank") >= lower, F.struct("_rank", "_v"))).alias("_lo"),
        F.min(F.when(F.col("_rank") >= upper, F.struct("_rank", "_v"))).alias("_hi"),
    )
    lo, hi = F.col("_lo._v"), F.col("_hi._v")
    share = place - F.floor(place)
    missed = F.raise_error(F.lit("a quantile lies outside its bracket; raise the accuracy")).cast("double")
    return stats.select(
        *[F.col("_group")[name].alias(name) for name in names],
        "n",
        "probability",
        F.when(lo.isNull() | hi.isNull(), missed).otherwise(lo + (hi - lo) * share).alias("quantile"),
    )


def quartiles(df: DataFrame, keys: Sequence[str], column: str, accuracy: int = ACCURACY) -> DataFrame:
    """(keys, q1, q3, iqr)."""
    q = exact_quantiles(df, keys, column, [0.25, 0.75], accuracy)

    def at(p):
        return F.max(F.when(F.col("probability") == p, F.col("quantile")))

    return q.groupBy(*keys).agg(at(0.25).alias("q1"), at(0.75).alias("q3")).withColumn("iqr", F.col("q3") - F.col("q1"))

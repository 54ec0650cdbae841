"""Ordered operators over series of any length.

A window over a whole series puts the series into one task. Here a series is cut into segments by
a pure function of time (or of an exact row position), windows run inside (series, segment), and
what has to cross a segment border is carried by a small table with one row per segment. A row's
segment never depends on the run, so recomputed tasks give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.dates import epoch_micros, frequency_seconds

SEGMENT = "_segment"
POSITION = "_position"
SERIES_ROWS = "_series_rows"
DEFAULT_WIDTH = "30D"  # 720 rows of hourly data; choose it so that a segment has 10^2 to 10^5 rows
DEFAULT_BLOCK = 4096


def floor_div(value: Column, width: int) -> Column:
    """Exact integer floor division."""
    return ((value - F.pmod(value, F.lit(width).cast("bigint"))) / width).cast("bigint")


def segment_of(order: Column, width: str | int) -> Column:
    """Segment number of a timestamp (width is a frequency) or of an integer (width is a number)."""
    if isinstance(width, int):
        return floor_div(order.cast("bigint"), width)
    return floor_div(epoch_micros(order), frequency_seconds(width) * 1_000_000)


def with_segment(df: DataFrame, order: str, width: str | int) -> DataFrame:
    """Add the segment. A row without a time has no place in a series: it fails the job. Rows without a
    series key belong to no series: the joins on the key leave them out."""
    if SEGMENT in df.columns:
        return df
    refused = F.raise_error(F.lit(f"a row without {order}")).cast("bigint")
    return df.withColumn(SEGMENT, F.when(F.col(order).isNotNull(), segment_of(F.col(order), width)).otherwise(refused))


# Candidate segment widths in minutes, narrow to wide.
WIDTHS = [1, 10, 60, 360, 1440, 10080, 43200]


def suggest_width(df: DataFrame, keys: Sequence[str], order: str, rows: int = 50_000) -> str:
    """The widest segment in which no series has more than ``rows`` rows, however dense a series is.

    One job with one row as its result: rows are counted per (series, narrowest width) with map-side
    combining, and the wider counts come from those. The default width suits hourly data; dense or
    uneven data should ask.
    """
    narrow = segment_of(F.col(order), f"{WIDTHS[0]}min")
    counts = df.groupBy(*keys, narrow.alias("_m")).agg(F.count("*").alias("_n"))
    parts = F.inline(
        F.array(*[F.struct(F.lit(w).alias("_w"), floor_div(F.col("_m"), w).alias("_s")) for w in WIDTHS])
    )
    full = (
        counts.select(*keys, "_n", parts)
        .groupBy(*keys, "_w", "_s")
        .agg(F.sum("_n").alias("_n"))
        .groupBy("_w")
        .agg(F.max("_n").alias("_n"))
        .where(F.col("_n") <= rows)
        .agg(F.max("_w"))
        .first()[0]
    )
    return f"{full or WIDTHS[0]}min"


def earlier(keys: Sequence[str], order: str = SEGMENT):
    """All segments of a series before this one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def later(keys: Sequence[str], order: str = SEGMENT):
    """All segments after this one, nearest last (a running frame is linear, a shrinking one is not)."""
    return Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "timestamp",
    width: str | int = DEFAULT_WIDTH,
    keep_segment: bool = False,
) -> DataFrame:
    """Add the exact 1-based row position within the series and the number of rows of the series.

    A segment column that is there already is used and stays; ``keep_segment`` keeps a new one, so that
    the next operator can work in the same partitioning.
    """
    keys = list(keys)
    rows = with_segment(df, order, width)
    sizes = rows.groupBy(*keys, SEGMENT).agg(F.count("*").alias("_rows"))
    offsets = sizes.select(
        *keys,
        SEGMENT,
        F.coalesce(F.sum("_rows").over(earlier(keys)), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias(SERIES_ROWS),
    )
    local = F.row_number().over(Window.partitionBy(*keys, SEGMENT).orderBy(order))
    placed = (
        rows.withColumn("_local", local)
        .join(offsets, [*keys, SEGMENT])
        .withColumn(POSITION, F.col("_offset") + F.col("_local"))
    )
    kept = [SEGMENT] if keep_segment and SEGMENT not in df.columns else []
    return placed.select(*df.columns, POSITION, SERIES_ROWS, *kept)


def with_regular_positions(df: DataFrame, order: str, step: str) -> DataFrame:
    """Positions on a complete regular axis: a function of time alone, so no shuffle."""
    return df.withColumn(POSITION, segment_of(F.col(order), step))


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    width: str | int = DEFAULT_WIDTH,
) -> DataFrame:
    """Add ``_prev_c`` and ``_next_c`` per column: the nearest (x, v) with a value, this row included.

    One shuffle on (series, segment) carries the rows; the segment table is joined on the same key.
    """
    keys = list(keys)
    rows = with_segment(df, order, width)
    first_last = []
    for c in columns:
        x = F.when(F.col(c).isNotNull(), F.col(order))
        first_last += [
            F.min(x).alias(f"_fx_{c}"),
            F.min_by(c, x).alias(f"_fv_{c}"),
            F.max(x).alias(f"_lx_{c}"),
            F.max_by(c, x).alias(f"_lv_{c}"),
        ]
    summary = rows.groupBy(*keys, SEGMENT).agg(*first_last)
    carry = summary.select(
        *keys,
        SEGMENT,
        *[
            F.last(F.col(f"_l{part}_{c}"), ignorenulls=True).over(earlier(keys)).alias(f"_c{part}_{c}")
            for c in columns
            for part in "xv"
        ],
        *[
            F.last(F.col(f"_f{part}_{c}"), ignorenulls=True).over(later(keys)).alias(f"_d{part}_{c}")
            for c in columns
            for part in "xv"
        ],
    )

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("x"), F.col(c).alias("v")))

    running = (Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(*keys, SEGMENT).orderBy(order).rowsBetween(*running)
    down = Window.partitionBy(*keys, SEGMENT).orderBy(F.col(order).desc()).rowsBetween(*running)
    local = rows.withColumns({f"_prev_{c}": F.last(known(c), ignorenulls=True).over(up) for c in columns})
    local = local.withColumns({f"_next_{c}": F.last(known(c), ignorenulls=True).over(down) for c in columns})

    def across(c: str, side: str, name: str) -> Column:
        carried = F.when(
            F.col(f"_{side}x_{c}").isNotNull(),
            F.struct(F.col(f"_{side}x_{c}").alias("x"), F.col(f"_{side}v_{c}").alias("v")),
        )
        return F.coalesce(F.col(name), carried).alias(name)

    # Every segment is in the table. An inner join gives both readers of the rows the same conditions,
    # so Spark shuffles them once and reuses the exchange.
    return local.join(carry, [*keys, SEGMENT]).select(
        *df.columns,
        *[across(c, "c", f"_prev_{c}") for c in columns],
        *[across(c, "d", f"_next_{c}") for c in columns],
    )


def blocks_with_history(df: DataFrame, history: int, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Assign rows with a position to blocks; each block also receives the ``history`` rows before it.

    Adds ``_block`` and ``_own`` (false on the copied rows). A row is copied at most once.
    """
    block = max(block, history)
    zero_based = F.col(POSITION) - 1
    home = floor_div(zero_based, block)
    near_end = F.pmod(zero_based, F.lit(block).cast("bigint")) >= block - history
    targets = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    return (
        df.withColumn("_home", home)
        .withColumn("_block", F.explode(targets))
        .withColumn("_own", F.col("_home") == F.col("_block"))
        .drop("_home")
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_block")

"""Long to wide, wide to long, and series as bounded pages of points."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.text import remove_literal
from seriesloom.operators.segments import POSITION, with_positions
from seriesloom.schema import LOCATION, PREDICTION_MEASURES


def check_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Columns must be the expected ones in order, up to case; they get the canonical names."""
    found = [c.lower() for c in df.columns]
    if found != [c.lower() for c in expected]:
        raise ValueError(f"columns {df.columns} do not match {list(expected)}")
    return df.toDF(*expected)


def sort_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The expected columns in their order, found up to case; a missing or further one is refused."""
    found = {c.lower(): c for c in df.columns}
    wanted = [c.lower() for c in expected]
    if len(found) != len(df.columns) or set(found) != set(wanted):
        raise ValueError(f"columns {df.columns} do not match {list(expected)}")
    return check_columns(df.select(*[found[c] for c in wanted]), expected)


def first_of_each_name(columns: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(columns))


def matching_columns(df: DataFrame, patterns: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """Keep columns whose name contains a match of any pattern."""
    import re

    either = re.compile("|".join(patterns))
    return df.select([c for c in df.columns if c in always or either.search(c)])


def unpivot_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide to (ids, variable_code, value); null values keep their row."""
    wide = df.select(*ids, *[F.col(c).cast("double") for c in columns])
    return wide.unpivot(list(ids), list(columns), "variable_code", "value")


def pivot_wide(
    df: DataFrame,
    variables: Sequence[str],
    keys: Sequence[str] = (*LOCATION, "timestamp"),
    recency: str | None = None,
) -> DataFrame:
    """Long to one column per variable in one aggregation.

    The table's key makes each cell unique; with ``recency`` the earliest row wins among duplicates.
    """
    variables = first_of_each_name(variables)

    def cell(v: str):
        hit = F.col("variable_code") == v
        value = F.when(hit, F.col("value"))
        return F.min_by("value", F.when(hit, F.col(recency))) if recency else F.max(value)

    return (
        df.where(F.col("variable_code").isin(*variables))
        .groupBy(*keys)
        .agg(*[cell(v).alias(v) for v in variables])
    )


def align_outer(frames: dict[str, DataFrame], keys: Sequence[str] = (*LOCATION, "timestamp")) -> DataFrame:
    """Full outer alignment of one (keys, value) frame per variable: a union and one aggregation."""
    tagged = [f.select(*keys, F.lit(name).alias("variable_code"), "value") for name, f in frames.items()]
    return pivot_wide(reduce(DataFrame.unionByName, tagged), list(frames), keys)


def pivot_predictions(
    df: DataFrame,
    targets: Sequence[str],
    keys: Sequence[str] = (*LOCATION, "timestamp"),
    measures: Sequence[str] = PREDICTION_MEASURES,
) -> DataFrame:
    """One ``{measure}_{target}`` column each. A second row for a (keys, target) fails the job."""
    df = df.withColumn("target_variable", remove_literal(F.col("target_variable")))

    def cell(measure: str, target: str):
        hit = F.col("target_variable") == target
        return (
            F.when(
                F.count_if(hit) > 1,
                F.raise_error(F.lit(f"duplicate prediction rows for {target}")).cast("double"),
            )
            .otherwise(F.max(F.when(hit, F.col(measure))))
            .alias(f"{measure}_{target}")
        )

    return (
        df.where(F.col("target_variable").isin(*targets))
        .groupBy(*keys)
        .agg(*[cell(m, t) for m in measures for t in targets])
    )


def pivot_config(df: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Entity-attribute-value rows to one row per (timestamp, stage); the first created value wins."""

    def cell(code: str):
        return F.min_by("parameter_value", F.when(F.col("parameter_code") == code, F.col("created_date")))

    return df.groupBy("timestamp", "stage").agg(*[cell(c).alias(c) for c in codes])


def series_points(
    df: DataFrame,
    keys: Sequence[str] = (*LOCATION, "variable_code"),
    order: str = "timestamp",
    page_rows: int = 1000,
    variables: Sequence[str] | None = None,
) -> DataFrame:
    """Ordered points per series in pages of ``page_rows`` points, so that no row holds more of a series."""
    if variables:
        df = df.where(F.col("variable_code").isin(*variables))
    points = F.sort_array(F.collect_list(F.struct(F.col(order), F.col("value"))))
    placed = with_positions(df, keys, order)
    return placed.groupBy(*keys, F.floor((F.col(POSITION) - 1) / page_rows).alias("page")).agg(
        F.min(order).alias("page_start"), F.count("*").alias("n_points"), points.alias("points")
    )

"""Writes: generic saves, the feature table with its mark, published predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.text import nan_to_null, strip_location
from seriesloom.operators.merge import marks_of, upsert_table, with_month
from seriesloom.operators.reshape import sort_columns, unpivot_long
from seriesloom.schema import (
    FEATURES,
    FEATURES_KEY,
    HIGH_WATER,
    HIGH_WATER_KEY,
    LOCATION,
    PREDICTIONS,
    PREDICTIONS_KEY,
    REGISTRY,
    REGISTRY_KEY,
    RUN_CONFIG,
    RUN_CONFIG_KEY,
)
from seriesloom.session import materialize

LAYOUT = {
    "features": (FEATURES_KEY, ["variable_code", "month"]),
    "predictions": (PREDICTIONS_KEY, ["target_variable", "month"]),
    "registry": (REGISTRY_KEY, ["model_type"]),
    "config": (RUN_CONFIG_KEY, ["stage"]),
    "marks": (HIGH_WATER_KEY, ["data_type"]),
}
SCHEMAS = {"features": FEATURES, "predictions": PREDICTIONS, "registry": REGISTRY, "config": RUN_CONFIG, "marks": HIGH_WATER}
# The first write of a configuration row sets its created_date, later ones leave it.
UPDATES = {"config": ["parameter_value", "update_date"]}


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "append") -> None:
    """Every row is written; NaN becomes null."""
    nan_to_null(df).write.mode(mode).partitionBy(*partition_by).parquet(path)


def save_table(spark: SparkSession, root: str, table: str, df: DataFrame, stored: bool = False) -> None:
    """Upsert into a stored table. Its columns are checked and put in order first."""
    keys, parts = LAYOUT[table]
    df = nan_to_null(sort_columns(df, SCHEMAS[table].names))
    df = with_month(df) if "month" in parts else df
    upsert_table(spark, f"{root}/{table}", df, keys, parts, UPDATES.get(table), stored)


def long_features(wide: DataFrame, variables: Sequence[str], update_date) -> DataFrame:
    """Wide (timestamp or date, location, variables) rows to rows of the feature table."""
    if "date" in wide.columns:
        wide = wide.withColumnRenamed("date", "timestamp")
    return unpivot_long(wide, ["timestamp", *LOCATION], variables).withColumn(
        "update_date", F.lit(update_date).cast("timestamp_ntz")
    )


def save_features(
    spark: SparkSession, root: str, long: DataFrame, update_date, data_type: str = "engineered_data"
) -> None:
    """Upsert the features, then advance each location's mark."""
    long = materialize(long)
    save_table(spark, root, "features", long)
    save_table(spark, root, "marks", marks_of(long, data_type, update_date))


def published(df: DataFrame, location: str | None = None) -> DataFrame:
    """Predictions with the location prefix taken off the target name."""
    prefix = (
        F.lit(location)
        if location is not None
        else F.concat_ws("/", F.col("latitude").cast("string"), F.col("longitude").cast("string"))
    )
    return df.withColumn("target_variable", strip_location(F.col("target_variable"), prefix))


def publish_predictions(
    spark: SparkSession, df: DataFrame, path: str, location: str | None = None, stored: bool = False
) -> None:
    """One output folder per target variable. Rows of other keys, as of other locations, stay as they are."""
    upsert_table(spark, path, published(df, location), PREDICTIONS_KEY, ["target_variable"], stored=stored)

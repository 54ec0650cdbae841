"""The given tables seen as the domain's tables.

``events`` are single observations: their hourly means are the observations of a site (ten users) and
a variable (event type). ``orders`` gives a model registry, run configurations and trial logs. The
number of sites grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.dates import hour_of
from seriesloom.functions.params import SEED_CONFIG
from seriesloom.operators.grid import complete_axis
from seriesloom.operators.impute import fill_chain
from seriesloom.operators.lags import add_lags
from seriesloom.operators.segments import POSITION, SERIES_ROWS, with_positions
from seriesloom.schema import LOCATION, SERIES
from seriesloom.session import materialize, materialize_alone
from seriesloom.sources.tables import date_bounds, series_of

VARIABLES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
UPDATED = "2024-02-01 00:00:00"
# A run from the first to the last of these, which is the second shifted back by so many hours, cut to the date.
RANGE, RANGE_HOURS = ("2024-01-08 00:00:00", "2024-01-26 12:00:00"), 440
TIE_SHIFT = 0.1234567  # in units of the last digit that is compared
NOW = "2001-08-02 00:00:00"
TARGET = [*LOCATION, "target_variable"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{d}/{name}.parquet")


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def coordinates(site):
    return {
        "latitude": (F.lit(4100) + site).cast("double") / F.lit(100.0),
        "longitude": (F.lit(200) + site).cast("double") / F.lit(100.0),
    }


def site_of(column: str):
    return F.expr(f"{column} div 10")


def cents_of(events: DataFrame) -> DataFrame:
    """Single observations with their hour and their value in cents, so that sums are exact."""
    return events.select(
        hour_of(F.col("ts")).alias("timestamp"),
        *[v.alias(k) for k, v in coordinates(site_of("user_id")).items()],
        F.col("event_type").alias("variable_code"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


def obs(spark: SparkSession, d: str) -> DataFrame:
    mean = F.sum("cents").cast("double") / (F.lit(100.0) * F.count("*"))
    return cents_of(table(spark, d, "events")).groupBy("timestamp", *SERIES).agg(mean.alias("value"))


def bounds(o: DataFrame) -> DataFrame:
    """Every series spans its location's time range, so series have leading and trailing gaps."""
    return series_of(o).join(date_bounds(o), LOCATION)


def grid(spark: SparkSession, d: str) -> DataFrame:
    o = materialize(obs(spark, d))  # the stored observations: read for the rows and for the bounds
    return complete_axis(o, SERIES, bounds=bounds(o))


def filled(spark: SparkSession, d: str) -> DataFrame:
    """The stored feature table that later steps read."""
    return materialize(fill_chain(grid(spark, d), SERIES, ["value"]).select(*SERIES, "timestamp", "value"))


def as_target(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("variable_code", "target_variable")


def panel(spark: SparkSession, d: str, lags=(1, 2, 24)) -> DataFrame:
    """(location, target_variable, timestamp, value, lag_k ..., hour): complete rows only."""

    def lagged() -> DataFrame:
        placed = with_positions(as_target(filled(spark, d)), TARGET)
        complete = add_lags(placed, TARGET, "value", list(lags)).na.drop()
        return complete.withColumn("hour", F.hour("timestamp").cast("double")).drop(POSITION, SERIES_ROWS)

    return materialize_alone(spark, lagged)


def preds(spark: SparkSession, d: str) -> DataFrame:
    """Seasonal naive predictions: the value of the day before."""
    return panel(spark, d, (24,)).select(
        *TARGET,
        "timestamp",
        F.col("value").alias("real_value"),
        F.col("lag_24").alias("predictions"),
        ntz("2024-01-31 00:00:00").alias("model_date"),
        F.lit("seasonal_naive").alias("model_name"),
        F.lit("autoval_reg").alias("model_type"),
        F.lit(1).alias("model_version"),
    )


def registry(spark: SparkSession, d: str) -> DataFrame:
    """One model per order. The date is unique, so is the key."""
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, d, "orders").select(
        F.timestamp_micros(micros).cast("timestamp_ntz").alias("model_date"),
        F.when(F.col("o_orderkey") % 2 == 0, "linear_regression").otherwise("xgboost_regression").alias("model_name"),
        F.lit("autoval_reg").alias("model_type"),
        *[v.alias(k) for k, v in coordinates(site_of("o_custkey")).items()],
        F.col("o_orderpriority").alias("target_variable"),
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).alias("model_version"),
        ((cents % 101).cast("double")).alias("model_forecast_accuracy"),
        F.col("o_totalprice").alias("model_metric_test_value"),
        F.col("o_orderkey").alias("model_path"),
    )


def config(spark: SparkSession, d: str) -> DataFrame:
    """The seed configuration for each effective hour that occurs in the orders."""
    stamps = (
        table(spark, d, "orders")
        .select(
            (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_custkey") % 24).cast("int"))).alias(
                "timestamp"
            )
        )
        .distinct()
    )
    seeds = F.array(
        *[
            F.struct(
                F.lit(stage).alias("stage"),
                F.lit(code).alias("parameter_code"),
                F.lit(value).alias("parameter_value"),
                F.lit(i).alias("_i"),
            )
            for i, (stage, code, value) in enumerate(SEED_CONFIG)
        ]
    )
    created = F.col("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("_i"))
    return (
        stamps.select("timestamp", F.inline(seeds))
        .withColumns({"created_date": created, "update_date": created})
        .drop("_i")
    )


def marks(spark: SparkSession, d: str) -> DataFrame:
    """Mark of each site: its last observation before Jan 20. Sites without one have no mark."""
    return (
        obs(spark, d)
        .where(F.col("timestamp") < ntz("2024-01-20 00:00:00"))
        .groupBy(*LOCATION)
        .agg(F.max("timestamp").alias("timestamp"))
        .select(*LOCATION, F.lit("engineered_data").alias("data_type"), "timestamp", ntz(UPDATED).alias("update_date"))
    )


def trial_log(spark: SparkSession, d: str) -> DataFrame:
    """One study per customer, one trial per order."""
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("study"),
        "o_orderkey",
        F.col("o_totalprice").alias("score"),
        (F.col("o_orderstatus") == "P").alias("pruned"),
    )
    placed = with_positions(rows, ["study"], "o_orderkey", 1 << 16)
    return placed.select("study", (F.col(POSITION) - 1).alias("trial"), "score", "pruned")

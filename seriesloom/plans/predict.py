"""Score rows with the best registered models and validate the outcome."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.dates import resolve_prediction_range, within
from seriesloom.operators.boosted import score_model
from seriesloom.operators.linear import score_linear
from seriesloom.operators.merge import marks_of, since_mark, table_exists
from seriesloom.operators.registry import best_model
from seriesloom.operators.scaling import with_named_terms
from seriesloom.operators.smoothing import smooth_predictions
from seriesloom.operators.validate import TARGET, own_thresholds, prediction_records
from seriesloom.schema import LOCATION
from seriesloom.session import materialize, materialize_alone, scratch_scope
from seriesloom.sources.sinks import publish_predictions, save_table

IDENTITY = ["model_date", "model_name", "model_type", "model_version", "lower_limit", "upper_limit"]


def score_with_registry(df: DataFrame, registry: DataFrame, label: str) -> DataFrame:
    """Each row with the best model of its (location, target), whatever kind that is.

    Linear and polynomial models of all series score in one join; the terms that a model names are derived from
    the rows. Saved models are loaded once for each distinct path and score the rows of their series. A row
    whose series has no usable model fails the job, and no row is lost.
    """
    kind = F.when(F.col("coefficients").isNotNull(), "linear").when(F.col("model_path").isNotNull(), "saved")
    # One row per series; read for its names and paths, and by each way of scoring.
    models = materialize(best_model(registry).withColumn("_kind", kind).where(F.col("_kind").isNotNull()))
    message = F.concat(F.lit("no usable model for "), F.to_json(F.struct(*TARGET)))
    kinds = models.select(*TARGET, "_kind", F.col("model_path").alias("_path"))
    rows = df.join(kinds, TARGET, "left").withColumn("_kind", F.coalesce("_kind", F.raise_error(message)))
    linear = models.where("_kind = 'linear'")
    names = [r[0] for r in linear.select(F.explode("model_feature_names")).distinct().collect()]  # feature names
    small = linear.select(
        *TARGET, *IDENTITY, F.col("model_feature_names").alias("feature_names"), "coefficients", "intercept", "scaler"
    )
    own = rows.where("_kind = 'linear'").drop("_kind", "_path")
    out = score_linear(with_named_terms(own, names), small, TARGET, names, label, strict=True)
    out = out.select(*df.columns, *IDENTITY, "predictions")
    for path in [r[0] for r in models.where("_kind = 'saved'").select("model_path").distinct().collect()]:
        chosen = models.where(F.col("model_path") == path)
        part = rows.where(F.col("_path") == path).drop("_kind", "_path")
        out = out.unionByName(_score_saved(part, chosen, path, label).select(*df.columns, *IDENTITY, "predictions"))
    return out.withColumn("real_value", F.col(label).cast("double"))


def _score_saved(rows: DataFrame, models: DataFrame, path: str, label: str) -> DataFrame:
    """Rows with one saved model, which reads and predicts values scaled for each series."""
    names = list(models.select("model_feature_names").first()[0])
    keep = rows.columns
    scaled = with_named_terms(rows, names).join(models.select(*TARGET, *IDENTITY, "scaler"), TARGET)
    by_name = F.map_from_entries(F.transform("scaler", lambda s: F.struct(s["name"], F.struct(s["mean"], s["std"]))))
    scaled = scaled.withColumn("_scale", by_name)
    held = F.struct(*[F.col(c) for c in keep], *[F.col(c) for c in IDENTITY], F.element_at("_scale", F.lit(label)).alias("_own"))
    inputs = [
        ((F.col(n).cast("double") - F.element_at("_scale", F.lit(n))["mean"]) / F.element_at("_scale", F.lit(n))["std"]).alias(n)
        for n in names
    ]
    scored = score_model(PipelineModel.load(path), scaled.select(held.alias("_row"), *inputs))
    return scored.select(
        "_row.*", (F.col("predictions") * F.col("_row._own.std") + F.col("_row._own.mean")).alias("predictions")
    ).drop("_own")


def predict_and_validate(
    df: DataFrame,
    registry: DataFrame,
    label: str,
    validation_threshold: float = 1.5,
    accuracy_threshold: float = 85.0,
    update_date=None,
    smooth_rows: int = 100,
) -> DataFrame:
    """Score, validate, and smooth the predictions of each series as they are recorded.

    Each step is stored, so that the disk holds the shuffles of one step at a time. Until the end the rows carry only what
    the records are made of: the model, the actual value, the prediction and its smoothed value.
    """

    def smoothed() -> DataFrame:
        scored = score_with_registry(df, registry, label)
        rows = scored.select(*TARGET, "timestamp", *IDENTITY, "real_value", "predictions", F.col("predictions").alias("_smoothed"))
        return smooth_predictions(rows, TARGET, "_smoothed", rows=smooth_rows)

    rows = materialize_alone(df.sparkSession, smoothed)
    thresholds = materialize(own_thresholds(rows, validation_threshold))
    return prediction_records(rows, validation_threshold, accuracy_threshold, update_date, thresholds, "_smoothed")


def run_predict_job(
    spark: SparkSession,
    root: str,
    panel: DataFrame,
    label: str,
    update_date,
    publish_to: str | None = None,
    look_back: tuple[int, str, str] | None = None,
    **how,
) -> None:
    """Predict what is newer than each location's prediction mark (everything without marks), from the tables below ``root``.

    Scores and validates with the registry, smooths, upserts the records, advances the marks and publishes the records.
    Smoothing and thresholds see the whole panel; only new records are written. With ``look_back`` (steps, frequency, direction)
    a run reads only its range: from the prediction mark, else the feature mark shifted, to the feature mark. Then
    smoothing and thresholds see that range, and all its records are written.
    """
    with scratch_scope(spark):
        registry = spark.read.parquet(f"{root}/registry")
        if look_back is not None:
            window, frequency, direction = look_back
            marks = spark.read.parquet(f"{root}/marks")
            known = [marks.where(F.col("data_type") == kind) for kind in ("engineered_data", "predictions")]
            panel = within(panel, materialize(resolve_prediction_range(*known, window, frequency, direction)))

        def new_records() -> DataFrame:
            records = predict_and_validate(panel, registry, label, update_date=update_date, **how)
            if look_back is None and table_exists(spark, f"{root}/marks"):
                records = since_mark(records, spark.read.parquet(f"{root}/marks"), "predictions")
            return records

        records = materialize_alone(spark, new_records)
        if records.isEmpty():
            return
        save_table(spark, root, "predictions", records, stored=True)
        save_table(spark, root, "marks", marks_of(records.select(*LOCATION, "timestamp"), "predictions", update_date))
        if publish_to:
            publish_predictions(spark, records, publish_to, stored=True)

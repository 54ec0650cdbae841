"""Model registry: versions, choice of models, staleness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.validate import TARGET

MODEL_KEY = ["model_type", *TARGET]


def _newest(registry: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """One row per key: newest version, then newest date, then name. An aggregate, so a key with very
    many models is combined on the map side."""
    rest = [c for c in registry.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in columns])
    best = F.max_by(F.struct(*rest), rank).alias("_best")
    return registry.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*registry.columns)


def most_recent_models(registry: DataFrame, keys: Sequence[str] = MODEL_KEY) -> DataFrame:
    return _newest(registry, keys, "model_version", "model_date", "model_name")


def best_models_in_window(
    registry: DataFrame, keys: Sequence[str] = MODEL_KEY, days: int = 1, metric: str = "model_forecast_accuracy"
) -> DataFrame:
    """Models within ``days`` of their key's latest date that reach the best accuracy there.

    The two maxima are small combined aggregates joined back; ties stay.
    """
    keys = list(keys)
    latest = registry.groupBy(*keys).agg(F.max("model_date").alias("_latest"))
    span = F.make_dt_interval(F.lit(days))
    recent = (
        registry.join(latest, keys)
        .where(F.col("model_date").between(F.col("_latest") - span, F.col("_latest") + span))
        .drop("_latest")
    )
    best = recent.groupBy(*keys).agg(F.max(metric).alias("_best"))
    return recent.join(best, keys).where(F.col(metric) == F.col("_best")).drop("_best")


def best_model(registry: DataFrame, keys: Sequence[str] = MODEL_KEY, days: int = 1) -> DataFrame:
    """One model per key; the newest among the best."""
    return _newest(
        best_models_in_window(registry, keys, days), keys, "model_version", "model_date", "model_name"
    )


def next_versions(wanted: DataFrame, registry: DataFrame, keys: Sequence[str] = MODEL_KEY) -> DataFrame:
    """Each wanted key with the version its next model gets."""
    keys = list(keys)
    last = registry.groupBy(*keys).agg(F.max("model_version").alias("_last"))
    return (
        wanted.select(*keys)
        .distinct()
        .join(last, keys, "left")
        .select(*keys, (F.coalesce("_last", F.lit(0)) + 1).cast("int").alias("model_version"))
    )


def latest_training(targets: DataFrame, registry: DataFrame, keys: Sequence[str] = MODEL_KEY) -> DataFrame:
    """Targets with the date of their most recent model (by version); null when there is none."""
    keys = list(keys)
    newest = registry.groupBy(*keys).agg(
        F.max_by("model_date", F.struct("model_version", "model_date")).alias("last_trained")
    )
    return targets.select(*keys).distinct().join(newest, keys, "left")


def targets_to_train(
    targets: DataFrame, registry: DataFrame, now: Column, older_than_days: int = 7, keys: Sequence[str] = MODEL_KEY
) -> DataFrame:
    """Targets without a model, or whose most recent model is ``older_than_days`` old or more."""
    limit = now - F.make_dt_interval(F.lit(older_than_days))
    return (
        latest_training(targets, registry, keys)
        .where(F.col("last_trained").isNull() | (F.col("last_trained") <= limit))
        .withColumn("reason", F.when(F.col("last_trained").isNull(), "untrained").otherwise("stale"))
    )


def untrained_targets(targets: DataFrame, registry: DataFrame, keys: Sequence[str] = MODEL_KEY) -> DataFrame:
    return targets.select(*keys).distinct().join(registry.select(*keys), list(keys), "left_anti")


def models_matching_suffix(registry: DataFrame, target: str) -> DataFrame:
    """Models whose target name ends with the given text."""
    return registry.where(F.col("target_variable").endswith(target))

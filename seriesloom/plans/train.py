"""Train every configured model for every series that needs one, and register it."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.dates import resolve_training_range, within
from seriesloom.functions import metrics as M
from seriesloom.operators import boosted, linear
from seriesloom.operators.impute import complete_rows
from seriesloom.operators.merge import marks_of, table_exists
from seriesloom.operators.registry import next_versions, targets_to_train
from seriesloom.operators.scaling import scale_fit, scale_transform, with_polynomial
from seriesloom.operators.search import SearchResult, StopRules, search
from seriesloom.operators.segments import POSITION, SERIES_ROWS, with_positions
from seriesloom.operators.split import fold_block, rows_in_test
from seriesloom.operators.validate import TARGET
from seriesloom.schema import LOCATION, REGISTRY
from seriesloom.session import materialize, scratch_scope
from seriesloom.sources.sinks import save_table

LINEAR = "linear_regression"
POLYNOMIAL = "polynomial"
BOOSTED = "xgboost_regression"  # fixed value: the name users configure; trained as boosted trees


@dataclass
class TrainSettings:
    model_names: Sequence[str] = (LINEAR,)
    params: dict = field(default_factory=lambda: {LINEAR: {}, POLYNOMIAL: {}, BOOSTED: {}})
    model_type: str = "autoval_reg"
    metric: str = "root_mean_squared_error"
    test_size: float = 0.1
    cv_splits: int = 10
    n_iter: int = 100
    patience: int = 10
    stop_mode: str = "min"
    stop_threshold: float = 0.05
    n_study_runs: int = 1
    forecast_acc_threshold: float = 85.0
    older_than_days: int = 7
    parallelism: int = 2
    seed: int = 7

    def model_kind(self, name: str) -> str:
        """The trainer of a model name; a name without parameters is an error."""
        if name not in self.params:
            raise KeyError(f"no parameters for model {name!r}")
        if POLYNOMIAL in name:
            return POLYNOMIAL
        return LINEAR if LINEAR in name else BOOSTED


def split_panel(panel: DataFrame, settings: TrainSettings, keys: Sequence[str] = TARGET) -> DataFrame:
    """Add split, and the fold block of training rows. Materialised: every model reads it."""
    placed = with_positions(panel, keys)
    n = F.col(SERIES_ROWS)
    n_train = n - rows_in_test(n, settings.test_size)
    return materialize(
        placed.withColumn("split", F.when(F.col(POSITION) > n_train, "test").otherwise("train"))
        .withColumn(
            "fold_block",
            F.when(F.col("split") == "train", fold_block(settings.cv_splits, F.col(POSITION), n_train)),
        )
        .drop(POSITION, SERIES_ROWS)
    )


def train_linear(
    split: DataFrame,
    features: Sequence[str],
    label: str,
    settings: TrainSettings,
    model_name: str = LINEAR,
    keys: Sequence[str] = TARGET,
) -> DataFrame:
    """One fitted model per series with its scores: all series in the same jobs."""
    keys = list(keys)
    split = complete_rows(split, [*features, label])
    if settings.model_kind(model_name) == POLYNOMIAL:
        split, features = with_polynomial(split, features)
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    columns = [*features, label]
    scalers = scale_fit(train, keys, columns)
    scaled = scale_transform(train.select(*keys, "fold_block", *columns), keys, columns, scalers)
    fits = linear.linear_cv(scaled, keys, features, label, settings.metric).join(scalers, keys)
    models = materialize(fits)  # one row per series; read by the three steps below
    scored = linear.score_linear(test.select(*keys, "timestamp", *columns), models, keys, features, label)
    y, p = F.col(label).cast("double"), F.col("predictions")
    scores = scored.groupBy(*keys).agg(
        M.regression_metric(settings.metric, y, p).alias("test_score"),
        M.mean_forecast_accuracy(y, p).alias("forecast_accuracy"),
    )
    importances = (
        linear.linear_importance(test, models, keys, features)
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("feature_importances"))
    )
    return (
        models.join(scores, keys, "left")
        .join(importances, keys, "left")
        .withColumns({"model_name": F.lit(model_name), "model_path": F.lit(None).cast("string")})
        .withColumn("model_parameters", F.lit("{}"))
    )


def train_boosted(
    split: DataFrame,
    features: Sequence[str],
    label: str,
    settings: TrainSettings,
    path: str,
    model_name: str = BOOSTED,
    keys: Sequence[str] = TARGET,
    importance_permutations: int = 2,
) -> tuple[DataFrame, dict[str, SearchResult]]:
    """Search, fit and save one model for each target variable, and score each series.

    A target's model is pooled over its locations: every series is scaled by its own means and deviations first, as its
    registry row records. The study is repeated with other seeds until the test forecast accuracy reaches its goal.
    """
    keys, features = list(keys), list(features)
    split = complete_rows(split, [*features, label])
    columns = [*features, label]
    scalers = materialize(scale_fit(split.where(F.col("split") == "train"), keys, columns))
    raw = split.withColumn("_actual", F.col(label).cast("double"))
    scaled = materialize(scale_transform(raw, keys, columns, scalers))
    names = [r[0] for r in scaled.select("target_variable").distinct().orderBy("target_variable").collect()]
    parts, studies = [], {}
    for name in names:  # target variables are the few that a configuration lists
        own = scaled.where(F.col("target_variable") == name)
        place = f"{path}/{re.sub('[^A-Za-z0-9_-]', '_', name)}"
        models, studies[name] = _train_target(own, scalers, features, label, settings, place, model_name, keys, importance_permutations)
        parts.append(models)
    return reduce(lambda a, b: a.unionByName(b), parts), studies


def _train_target(scaled, scalers, features, label, settings, path, model_name, keys, importance_permutations):
    train, test = scaled.where(F.col("split") == "train"), scaled.where(F.col("split") == "test")
    larger = settings.metric in M.LARGER_IS_BETTER
    own = F.get(F.filter("scaler", lambda s: s["name"] == label), F.lit(0))

    def on_test(model) -> DataFrame:
        """Test rows with predictions in raw units."""
        rows = boosted.score_model(model, test).join(scalers, keys)
        return rows.withColumn("predictions", F.col("predictions") * own["std"] + own["mean"])

    best = None
    for run in range(settings.n_study_runs):
        seed = settings.seed + run
        rules = StopRules(settings.patience, "max" if larger else settings.stop_mode, settings.stop_threshold)
        found = search(
            train, features, label, settings.params[model_name], settings.n_iter, settings.cv_splits,
            rules, settings.metric, seed, settings.parallelism,
        )
        model = boosted.fit_gbt(train, features, label, found.params, seed)
        goal = on_test(model).agg(M.mean_forecast_accuracy(F.col("_actual"), F.col("predictions")).alias("a")).first()["a"]
        if best is None or rules.better(found.score, best[1].score):
            best = (model, found)
        if goal is not None and goal >= settings.forecast_acc_threshold:
            break
    model, found = best
    model.write().overwrite().save(path)
    y, p = F.col("_actual"), F.col("predictions")
    scores = on_test(model).groupBy(*keys).agg(
        M.regression_metric(settings.metric, y, p).alias("test_score"),
        M.mean_forecast_accuracy(y, p).alias("forecast_accuracy"),
    )
    phi = boosted.attributions(
        model, test, [*keys, "timestamp"], train, features, importance_permutations, seed=settings.seed
    )
    importances = (
        boosted.mean_attribution(phi, keys)
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("feature_importances"))
    )
    counts = train.groupBy(*keys).agg(F.count("*").alias("n"))
    models = (
        counts.join(scalers, keys)
        .join(scores, keys, "left")
        .join(importances, keys, "left")
        .withColumns(
            {
                "feature_names": F.array(*map(F.lit, features)),
                "coefficients": F.lit(None).cast("array<double>"),
                "intercept": F.lit(None).cast("double"),
                "validation_score": F.lit(float(found.score)),
                "model_name": F.lit(model_name),
                "model_path": F.lit(path),
                "model_parameters": F.lit(json.dumps(found.params)),
            }
        )
    )
    return materialize(models), found


def registry_rows(models: DataFrame, registry: DataFrame, settings: TrainSettings, model_date) -> DataFrame:
    """Trained models as registry rows. All models of one run get the same next version."""
    keyed = models.withColumn("model_type", F.lit(settings.model_type))
    versions = next_versions(keyed, registry)
    rows = (
        keyed.join(versions, ["model_type", *TARGET])
        .withColumnsRenamed(
            {
                "feature_names": "model_feature_names",
                "validation_score": "model_metric_validation_value",
                "test_score": "model_metric_test_value",
                "forecast_accuracy": "model_forecast_accuracy",
            }
        )
        .withColumns(
            {
                "model_date": F.lit(model_date).cast("timestamp_ntz"),
                "model_metric_name": F.lit(settings.metric),
                "model_features_count": F.size("model_feature_names"),
                "lower_limit": F.lit(float("-inf")),
                "upper_limit": F.lit(float("inf")),
            }
        )
    )
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in REGISTRY.fields])


def run_train_job(
    spark: SparkSession,
    root: str,
    panel: DataFrame,
    features: Sequence[str],
    label: str,
    settings: TrainSettings,
    model_date,
    start=None,
    end=None,
) -> None:
    """Train the series that are due, upsert their registry rows below ``root`` and advance the training marks.

    ``start`` and ``end`` limit the rows; without one, a location's first or last time takes its place.
    """
    with scratch_scope(spark):
        if start is not None or end is not None:
            bounds = panel.groupBy(*LOCATION).agg(F.min("timestamp").alias("min_date"), F.max("timestamp").alias("max_date"))
            given = [None if t is None else F.lit(t).cast("timestamp_ntz") for t in (start, end)]
            panel = within(panel, materialize(resolve_training_range(bounds, *given)))
        place = f"{root}/registry"
        registry = spark.read.parquet(place) if table_exists(spark, place) else spark.createDataFrame([], REGISTRY)
        registry = registry.select(*[F.col(f.name).cast(f.dataType) for f in REGISTRY.fields])
        rows = materialize(
            train_and_register(spark, panel, features, label, registry, settings, model_date, f"{root}/models")
        )
        if rows.isEmpty():
            return
        save_table(spark, root, "registry", rows)
        trained = panel.join(rows.select(*TARGET).distinct(), TARGET, "left_semi")
        save_table(spark, root, "marks", marks_of(trained, "training", model_date))


def train_and_register(
    spark: SparkSession,
    panel: DataFrame,
    features: Sequence[str],
    label: str,
    registry: DataFrame,
    settings: TrainSettings,
    model_date,
    model_root: str | None = None,
) -> DataFrame:
    """Registry rows of every configured model, for the series whose model is missing or too old.

    ``panel`` has (latitude, longitude, target_variable, timestamp), the features and the label.
    Names the settings list without a trainer of their own are left out.
    """
    due = targets_to_train(
        panel.select(*TARGET).distinct().withColumn("model_type", F.lit(settings.model_type)),
        registry,
        F.lit(model_date).cast("timestamp_ntz"),
        settings.older_than_days,
    )
    split = split_panel(panel.join(due.select(*TARGET), TARGET, "left_semi"), settings)
    parts = []
    for name in settings.model_names:
        if name in (LINEAR, POLYNOMIAL):
            parts.append(train_linear(split, features, label, settings, name))
        elif name == BOOSTED:
            if model_root is None:
                raise ValueError("boosted models need a folder to be saved in")
            parts.append(train_boosted(split, features, label, settings, f"{model_root}/{name}")[0])
    if not parts:
        raise ValueError("no trainable model is configured")
    models = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return registry_rows(models, registry, settings, model_date)

"""Scores of predictions, grouped by any key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import metrics as M


def evaluate_regression(
    df: DataFrame,
    keys: Sequence[str],
    actual: str = "real_value",
    predicted: str = "predictions",
    names: Sequence[str] = tuple(M.REGRESSION),
    zero_actual: str = "skip",
) -> DataFrame:
    """All metrics and the forecast accuracy in one pass."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *M.regression_metrics(y, p, names),
        M.mean_forecast_accuracy(y, p, zero_actual).alias("forecast_accuracy"),
        M.zero_actuals(y).alias("zero_actuals"),
    )


def confusion_matrix(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    return df.groupBy(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def class_counts(confusion: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True positives, false positives and false negatives of each class, from the small matrix."""
    hit = F.col("actual") == F.col("predicted")
    none = F.lit(0).cast("bigint")
    as_actual = F.struct(
        F.col("actual").alias("class"),
        F.when(hit, F.col("n")).otherwise(none).alias("tp"),
        none.alias("fp"),
        F.when(hit, none).otherwise(F.col("n")).alias("fn"),
    )
    as_predicted = F.struct(
        F.col("predicted").alias("class"),
        none.alias("tp"),
        F.when(hit, none).otherwise(F.col("n")).alias("fp"),
        none.alias("fn"),
    )
    return (
        confusion.select(*keys, F.inline(F.array(as_actual, as_predicted)))
        .groupBy(*keys, "class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )


def _f1(tp, fp, fn):
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def classification_scores(confusion: DataFrame, keys: Sequence[str], positive=1) -> DataFrame:
    """Accuracy, balanced accuracy and F1 by every averaging mode, from the small matrix."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    support = tp + fn
    total = F.sum(support)
    return (
        class_counts(confusion, keys)
        .groupBy(*keys)
        .agg(
            total.alias("n"),
            (F.sum(tp) / total).alias("accuracy"),
            F.avg(F.try_divide(tp, support)).alias("balanced_accuracy"),
            F.avg(_f1(tp, fp, fn)).alias("f1_macro"),
            _f1(F.sum(tp), F.sum(fp), F.sum(fn)).alias("f1_micro"),
            (F.sum(_f1(tp, fp, fn) * support) / total).alias("f1_weighted"),
            F.coalesce(F.max(F.when(F.col("class") == positive, _f1(tp, fp, fn))), F.lit(0.0)).alias("f1_binary"),
        )
    )


def evaluate_classification(
    df: DataFrame,
    metric: str,
    actual: str,
    predicted: str,
    keys: Sequence[str] = (),
    average: str = "binary",
    positive=1,
) -> DataFrame:
    """(keys, score) of one metric by name."""
    if metric == "neg_log_loss":
        return df.groupBy(*keys).agg(M.log_loss(F.col(actual), F.col(predicted)).alias("score"))
    columns = {"accuracy": "accuracy", "balanced_accuracy": "balanced_accuracy", "f1_score": f"f1_{average}"}
    if metric not in columns:
        raise NotImplementedError(f"unknown classification metric {metric!r}")
    scores = classification_scores(confusion_matrix(df, keys, actual, predicted), keys, positive)
    return scores.select(*keys, F.col(columns[metric]).alias("score"))

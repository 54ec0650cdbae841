"""Boosted trees on one pooled panel, and attributions of any fitted model."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import materialize

# User-level parameter names and their MLlib counterparts.
PARAMETERS = {
    "n_estimators": "maxIter",
    "max_depth": "maxDepth",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
    "min_child_weight": "minInstancesPerNode",
    "min_split_loss": "minInfoGain",
}
# Known to users but without a counterpart: only their neutral value 0 is accepted.
WITHOUT_COUNTERPART = {"reg_alpha", "reg_lambda", "max_delta_step"}
INTEGERS = {"maxIter", "maxDepth", "minInstancesPerNode"}


def to_mllib(params: dict) -> dict:
    out = {}
    for name, value in params.items():
        name = name.split("__")[-1]
        if name in WITHOUT_COUNTERPART:
            if value:
                raise ValueError(f"{name} = {value} has no counterpart; leave it out or set it to 0")
            continue
        if name not in PARAMETERS:
            raise KeyError(f"unknown boosted-tree parameter {name!r}")
        key = PARAMETERS[name]
        out[key] = int(value) if key in INTEGERS else float(value)
    if not 0 < out.get("stepSize", 1.0) <= 1:
        raise ValueError(f"learning_rate must lie in (0, 1], not {out['stepSize']}")
    if not 0 <= out.get("maxDepth", 0) <= 30:
        raise ValueError(f"max_depth must lie in 0 to 30, not {out['maxDepth']}")
    return out


def usable_ranges(ranges: dict) -> dict:
    """The ranges that a search may draw from; those without a counterpart are left out with a warning."""
    lost = sorted(n for n in ranges if n.split("__")[-1] in WITHOUT_COUNTERPART)
    if lost:
        warnings.warn(f"not searched, as the trainer has no counterpart: {', '.join(lost)}", stacklevel=2)
    return {n: r for n, r in ranges.items() if n not in lost}


def fit_gbt(train: DataFrame, features: Sequence[str], label: str, params: dict | None = None, seed: int = 7):
    """A squared-error boosted-tree pipeline. Executors may be lost in mid-fit: the id cache is
    checkpointed in the session's checkpoint folder every few trees."""
    gbt = GBTRegressor(
        featuresCol="_features",
        labelCol=label,
        predictionCol="predictions",
        lossType="squared",
        seed=seed,
        checkpointInterval=10,
        **to_mllib(params or {}),
    )
    steps = [VectorAssembler(inputCols=list(features), outputCol="_features"), gbt]
    return Pipeline(stages=steps).fit(train.select(*features, label).na.drop())


def score_model(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("_features")


def attributions(
    model: PipelineModel,
    rows: DataFrame,
    row_id: Sequence[str],
    background: DataFrame,
    features: Sequence[str],
    permutations: int = 2,
    seed: int = 7,
    per_bucket: int = 64,
) -> DataFrame:
    """(row_id, feature, phi): Shapley values sampled over feature orders and background rows.

    Each (row, order) draws one row of the whole background: rows are dealt into buckets of about
    ``per_bucket`` by the hash of a row number and numbered inside, and an equi-join on bucket and number
    fetches the one drawn. From it a walk leads to the row itself, one feature at a time. A feature's value
    is the difference of two neighbouring points, so each point adds +f to one feature and -f to the next.
    """
    p, row_id, features = len(features), list(row_id), list(features)
    salted = F.xxhash64(*row_id, F.lit(seed), F.col("_m"))
    numbered = materialize(
        background.select(*[F.col(f).cast("double").alias(f"_bg_{f}") for f in features])
        .na.drop()
        .withColumn("_row", F.monotonically_increasing_id())
    )
    n = numbered.count()
    if not n:
        raise ValueError("the background has no complete rows")
    buckets = F.lit(n // per_bucket + 1).cast("bigint")
    dealt = numbered.withColumn("_b", F.pmod(F.xxhash64("_row", F.lit(seed)), buckets))
    inside = Window.partitionBy("_b").orderBy("_row")  # about per_bucket rows each
    table = dealt.withColumn("_slot", F.row_number().over(inside) - 1).drop("_row")
    sizes = dealt.groupBy("_b").agg(F.count("*").alias("_size"))
    empty = F.raise_error(F.lit("a background bucket is empty; raise per_bucket")).cast("bigint")
    walks = (
        rows.select(*row_id, *features)
        .na.drop()
        .withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
        .withColumn("_b", F.pmod(salted, buckets))
        .join(sizes, "_b", "left")
        .withColumn("_slot", F.pmod(F.xxhash64(salted), F.coalesce("_size", empty)).cast("int"))
        .join(table, ["_b", "_slot"])
        .withColumn(
            "_order",
            F.transform(
                F.array_sort(
                    F.array(
                        *[F.struct(F.xxhash64(salted, F.lit(f)).alias("h"), F.lit(f).alias("f")) for f in features]
                    )
                ),
                lambda s: s["f"],
            ),
        )
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(p))))
    )
    point = walks.withColumns(
        {
            f: F.when(F.array_position("_order", F.lit(f)) <= F.col("_step"), F.col(f).cast("double")).otherwise(
                F.col(f"_bg_{f}")
            )
            for f in features
        }
    )
    scored = score_model(model, point)
    value = F.col("predictions")
    parts = F.filter(
        F.array(
            F.struct(F.get("_order", F.col("_step") - 1).alias("feature"), value.alias("part")),
            F.struct(F.get("_order", F.col("_step")).alias("feature"), (-value).alias("part")),
        ),
        lambda s: s["feature"].isNotNull(),
    )
    return (
        scored.select(*row_id, F.inline(parts))
        .groupBy(*row_id, "feature")
        .agg((F.sum("part") / permutations).alias("phi"))
    )


def mean_attribution(phi: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return phi.groupBy(*keys, "feature").agg(F.avg(F.abs("phi")).alias("importance"))

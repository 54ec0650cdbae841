"""Linear regression for many series at once.

All that a fit needs from the rows is a matrix of sums of products. Those sums combine on the map
side, so one hot series costs no more per task than any other, and one pass over the rows serves
every fold of the expanding-window cross-validation: fold f trains on blocks 0..f and is tested on
block f + 1. Only the small solve runs in Python, on one bounded row per series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import metrics as M
from seriesloom.operators.impute import complete_rows

FIT = (
    "struct<coefficients:array<double>,intercept:double,n:bigint,"
    "folds:array<struct<fold:int,coefficients:array<double>,intercept:double,n_test:bigint,sse:double,sst:double>>>"
)
#: Most features whose products are summed one by one in generated code, and tasks' matrices added in one round.
UNROLLED, ROUND = 20, 32
# Metrics that follow from the sums of a test block, without reading its rows again.
FROM_SUMS = {
    "mean_squared_error": lambda f: F.try_divide(f["sse"], f["n_test"]),
    "root_mean_squared_error": lambda f: F.sqrt(F.try_divide(f["sse"], f["n_test"])),
    "r2": lambda f: 1 - F.try_divide(f["sse"], f["sst"]),
}


def product_sums(features: Sequence[str], label: str) -> Column:
    """Upper triangle of the sums of products of (1, features, label), row by row."""
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(label).cast("double")]
    return F.array(*[F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))])


def matrix_sums(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    """(keys, block, sums) as ``product_sums`` gives them, for so many features that single sums would not compile.

    Each task sorts its rows by series and block and multiplies one matrix after the other; a series' matrices, one
    from each task that holds it, are added in two rounds, so a hot series sends no long list to one place.
    """
    by, columns = [*keys, "_number"], [*features, label]
    numbers = df.select(*by, F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")).sortWithinPartitions(*by)
    kinds = {f.name: f.dataType.simpleString() for f in numbers.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by)
    upper = np.triu_indices(len(columns) + 1)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, total = TaskContext.get().partitionId() % ROUND, None, None

        def row(key: pa.RecordBatch, m: np.ndarray) -> pa.RecordBatch:
            arrays = [*key.columns, pa.array([part], pa.int32()), pa.array([m[upper].tolist()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(arrays, names=[*by, "_part", "sums"])

        for batch in batches:
            key = batch.select(by)
            x = batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, len(columns))
            z = np.column_stack([np.ones(len(x)), x])
            same = np.ones(max(0, len(x) - 1), bool)
            for c in key.columns:
                v = np.asarray(c.to_pylist(), dtype=object)
                same &= v[1:] == v[:-1]
            starts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(x)]
            for a, b in zip(starts, starts[1:]):
                own = key.slice(a, 1)
                if held is not None and not own.equals(held):
                    yield row(held, total)
                    total = None
                m = z[a:b].T @ z[a:b]
                held, total = own, m if total is None else total + m
        if held is not None:
            yield row(held, total)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[[0]].copy()
        first["sums"] = [np.sum(np.stack(group["sums"].to_list()), axis=0)]
        return first

    out = numbers.mapInArrow(multiply, f"{schema}, _part int, sums array<double>")
    out = out.groupBy(*by, "_part").applyInPandas(add, out.schema)
    out = out.groupBy(*by).applyInPandas(add, out.schema)
    return out.select(*keys, F.col("_number").alias("block"), "sums")


def _matrix(flat) -> np.ndarray:
    flat = np.asarray(flat, float)
    size = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = flat
    return full + np.triu(full, 1).T


def solve(m: np.ndarray) -> tuple[np.ndarray, float]:
    """Least squares on centred sums; the smallest solution when columns depend on each other."""
    n, p = m[0, 0], len(m) - 2
    mean = m[0] / n
    centred = m - n * np.outer(mean, mean)
    coef = np.linalg.pinv(centred[1 : p + 1, 1 : p + 1], rcond=1e-10, hermitian=True) @ centred[1 : p + 1, p + 1]
    return coef, float(mean[p + 1] - coef @ mean[1 : p + 1])


def squared_error(m: np.ndarray, coef: np.ndarray, intercept: float) -> tuple[float, float]:
    """Squared error of a fit on a block, and the block's spread around its own mean."""
    w = np.concatenate([[intercept], coef, [-1.0]])
    return max(0.0, float(w @ m @ w)), float(m[-1, -1] - m[0, -1] ** 2 / m[0, 0])


def fit_blocks(blocks: dict[int, np.ndarray]) -> dict:
    """Final fit over all blocks, and the fit and test error of each fold."""
    folds, train = [], None
    for b in sorted(blocks):
        if b > 0 and train is not None:
            coef, intercept = solve(train)
            sse, sst = squared_error(blocks[b], coef, intercept)
            folds.append(
                {
                    "fold": b - 1,
                    "coefficients": coef.tolist(),
                    "intercept": intercept,
                    "n_test": int(blocks[b][0, 0]),
                    "sse": sse,
                    "sst": sst,
                }
            )
        train = blocks[b] if train is None else train + blocks[b]
    coef, intercept = solve(train)
    return {"coefficients": coef.tolist(), "intercept": intercept, "n": int(train[0, 0]), "folds": folds}


def _fit(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in batches:
        yield pd.DataFrame(
            [fit_blocks({int(b["block"]): _matrix(b["sums"]) for b in row}) for row in series],
            columns=["coefficients", "intercept", "n", "folds"],
        )


def linear_fit(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, block: str | None = None
) -> DataFrame:
    """(keys, feature_names, coefficients, intercept, n, folds). Incomplete rows are left out.

    ``block`` names the fold block column; without it there are no folds. A series sends at most
    ``n_splits + 1`` rows of sums to its solve.
    """
    keys, features = list(keys), list(features)
    complete = complete_rows(df, [*features, label])
    number = F.col(block) if block else F.lit(0)
    if len(features) <= UNROLLED:
        sums = complete.groupBy(*keys, number.alias("block")).agg(product_sums(features, label).alias("sums"))
    else:
        sums = matrix_sums(complete.withColumn("_number", number.cast("int")), keys, features, label)
    per_series = sums.groupBy(*keys).agg(F.collect_list(F.struct("block", "sums")).alias("_blocks"))
    return per_series.select(*keys, F.pandas_udf(_fit, FIT)("_blocks").alias("_fit")).select(
        *keys, F.array(*map(F.lit, features)).alias("feature_names"), "_fit.*"
    )


def dot(coefficients: Column, features: Sequence[str]) -> Column:
    """Unrolled, so that it stays inside generated code."""
    total = F.lit(0.0)
    for i, c in enumerate(features):
        total = total + F.get(coefficients, F.lit(i)) * F.col(c)
    return total


def fold_scores(fits: DataFrame, keys: Sequence[str], metric: str = "root_mean_squared_error") -> DataFrame:
    """(keys, fold, score) from the sums alone."""
    if metric not in FROM_SUMS:
        raise NotImplementedError(f"{metric!r} needs the rows; use fold_row_scores")
    fold = fits.select(*keys, F.explode("folds").alias("_f"))
    return fold.select(*keys, F.col("_f.fold").alias("fold"), FROM_SUMS[metric](F.col("_f")).alias("score"))


def fold_row_scores(
    df: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    label: str,
    metric: str,
    block: str = "fold_block",
) -> DataFrame:
    """(keys, fold, score) by scoring the rows of each test block, for any metric."""
    keys = list(keys)
    models = fits.select(*keys, F.explode("folds").alias("_f")).select(
        *keys, (F.col("_f.fold") + 1).alias(block), F.col("_f.coefficients").alias("_c"), F.col("_f.intercept").alias("_i")
    )
    scored = df.join(models, [*keys, block]).withColumn("_p", F.col("_i") + dot(F.col("_c"), features))
    return scored.groupBy(*keys, (F.col(block) - 1).alias("fold")).agg(
        M.regression_metric(metric, F.col(label), F.col("_p")).alias("score")
    )


def linear_cv(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    label: str,
    metric: str = "root_mean_squared_error",
    block: str = "fold_block",
) -> DataFrame:
    """The final fit of each series with its mean fold score."""
    fits = linear_fit(df, keys, features, label, block)
    if metric in FROM_SUMS:
        scores = F.transform("folds", FROM_SUMS[metric])
        scores = F.filter(scores, lambda s: s.isNotNull())
        mean = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, s: a + s), F.size(scores))
        return fits.withColumn("validation_score", mean)
    by_fold = fold_row_scores(df, fits, keys, features, label, metric, block)
    means = by_fold.groupBy(*keys).agg(F.avg("score").alias("validation_score"))
    return fits.join(means, list(keys), "left")


def mean_fold_coefficients(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, coefficient): each coefficient's mean over the folds."""
    return (
        fits.select(*keys, "feature_names", F.explode("folds").alias("_f"))
        .select(*keys, F.inline(F.arrays_zip(F.col("feature_names").alias("feature"), F.col("_f.coefficients").alias("c"))))
        .groupBy(*keys, "feature")
        .agg(F.avg("c").alias("coefficient"))
    )


def in_raw_units(models: DataFrame, label: str) -> DataFrame:
    """Fold the scaler into the coefficients, on the small model table: rows need no scaling.

    Adds ``raw_coefficients`` (name to slope) and ``raw_intercept``.
    """
    by_name = F.map_from_entries(
        F.transform("scaler", lambda s: F.struct(s["name"], F.struct(s["mean"], s["std"])))
    )
    own = F.element_at("_scale", F.lit(label))
    slopes = F.transform(
        "feature_names",
        lambda f, i: F.get("coefficients", i) * own["std"] / F.element_at(F.col("_scale"), f)["std"],
    )
    shift = F.aggregate(
        F.arrays_zip("_slopes", "feature_names"),
        F.lit(0.0),
        lambda a, z: a + z["_slopes"] * F.element_at(F.col("_scale"), z["feature_names"])["mean"],
    )
    return (
        models.withColumn("_scale", by_name)
        .withColumn("_slopes", slopes)
        .withColumn("raw_intercept", F.col("intercept") * own["std"] + own["mean"] - shift)
        .withColumn("raw_coefficients", F.map_from_arrays("feature_names", "_slopes"))
        .drop("_scale", "_slopes")
    )


def score_linear(
    df: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, strict: bool = False
) -> DataFrame:
    """Rows x the models of their key, one output row each, with ``predictions`` in raw units.

    ``features`` is every feature any model may use; one a model lacks counts 0, and one the rows
    lack counts as a zero value. Rows without a model are left out, or with ``strict`` fail the job.
    """
    raw = in_raw_units(models, label)
    present = [f for f in features if f in df.columns]
    slopes = F.array(*[F.coalesce(F.try_element_at("raw_coefficients", F.lit(f)), F.lit(0.0)) for f in present])
    small = raw.withColumn("_slopes", slopes).drop(
        "coefficients", "intercept", "raw_coefficients", "feature_names", "scaler", "folds"
    )
    if not strict:
        joined = df.join(small, list(keys))
        intercept = F.col("raw_intercept")
    else:
        joined = df.join(small, list(keys), "left")
        message = F.concat(F.lit("no model for "), F.to_json(F.struct(*keys)))
        intercept = F.coalesce("raw_intercept", F.raise_error(message).cast("double"))
    return joined.withColumn("predictions", intercept + dot(F.col("_slopes"), present)).drop(
        "_slopes", "raw_intercept"
    )


def linear_importance(
    df: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str]
) -> DataFrame:
    """(keys, feature, importance): mean of |coefficient * (x - training mean) / deviation|.

    For a linear model this is the exact mean absolute Shapley attribution, in units of the scaled
    target. ``models`` has coefficients and a scaler whose first entries are ``features`` in order.
    """
    small = models.select(*keys, F.col("coefficients").alias("_c"), F.col("scaler").alias("_s"))

    def share(i: int, c: str) -> Column:
        s = F.get("_s", F.lit(i))
        return F.avg(F.abs(F.get("_c", F.lit(i)) * (F.col(c) - s["mean"]) / s["std"]))

    wide = df.join(small, list(keys)).groupBy(*keys).agg(*[share(i, c).alias(c) for i, c in enumerate(features)])
    return wide.unpivot(list(keys), list(features), "feature", "importance")

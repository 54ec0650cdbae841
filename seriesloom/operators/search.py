"""Hyper-parameter search with time-series folds, pruning and stopping rules."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import median

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions.metrics import regression_metric
from seriesloom.operators.boosted import fit_gbt, score_model, to_mllib, usable_ranges
from seriesloom.operators.evaluate import evaluate_classification
from seriesloom.operators.segments import SEGMENT, earlier, segment_of

TRIAL_SCHEMA = "trial int, params map<string,double>, score double, pruned boolean"


def draw(ranges: dict, rng: random.Random) -> dict:
    """One sample: integers and floats between the range's ends, anything else one of the values."""
    out = {}
    for name, values in ranges.items():
        values = list(values)
        if isinstance(values[0], bool) or not isinstance(values[0], (int, float)):
            out[name] = rng.choice(values)
        elif isinstance(values[0], int):
            out[name] = rng.randint(int(min(values)), int(max(values)))
        else:
            out[name] = rng.uniform(min(values), max(values))
    return out


@dataclass
class StopRules:
    """Stop after ``patience`` trials without a better score, ``patience`` pruned trials in a row, or
    a score past the threshold in the direction of ``mode``."""

    patience: int = 10
    mode: str = "min"
    threshold: float | None = None
    best: float | None = None
    waited: int = 0
    pruned: int = 0

    def __post_init__(self):
        if self.mode not in ("min", "max"):
            raise ValueError("mode must be 'min' or 'max'")

    def better(self, a: float, b: float) -> bool:
        return a < b if self.mode == "min" else a > b

    def stop(self, score: float | None, was_pruned: bool = False) -> bool:
        self.pruned = self.pruned + 1 if was_pruned else 0
        if score is not None and not was_pruned and (self.best is None or self.better(score, self.best)):
            self.best, self.waited = score, 0
        elif self.best is not None:
            self.waited += 1
        past = self.threshold is not None and self.best is not None and self.better(self.best, self.threshold)
        return past or self.waited >= self.patience or self.pruned >= self.patience


@dataclass
class SearchResult:
    params: dict
    score: float
    trials: list = field(default_factory=list)

    def log(self, spark: SparkSession) -> DataFrame:
        rows = [(t, {k: float(v) for k, v in p.items()}, s, pr) for t, p, s, pr in self.trials]
        return spark.createDataFrame(rows, TRIAL_SCHEMA)


def gbt_fold_score(
    panel: DataFrame, features: Sequence[str], label: str, params: dict, fold: int, metric: str, seed: int
) -> float | None:
    """Train on blocks <= fold and score block fold + 1."""
    model = fit_gbt(panel.where(F.col("fold_block") <= fold), features, label, params, seed)
    test = panel.where(F.col("fold_block") == fold + 1)
    row = score_model(model, test).agg(regression_metric(metric, F.col(label), F.col("predictions")).alias("s")).first()
    return row["s"]


def classifier_fold_score(row_id: Sequence[str], n_folds: int, average: str = "binary") -> Callable:
    """A score for ``search``: a boosted-tree classifier per shuffled fold. Folds are a hash of the row
    id, so they need no shuffle and are the same in every run."""

    def score(panel, features, label, params, fold, metric, seed) -> float | None:
        part = F.pmod(F.xxhash64(*row_id, F.lit(seed)), F.lit(n_folds).cast("bigint"))
        train, test = panel.where(part != fold), panel.where(part == fold)
        assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
        model = GBTClassifier(
            featuresCol="_features", labelCol=label, predictionCol="predictions", seed=seed, **to_mllib(params)
        ).fit(assembler.transform(train))
        scored = model.transform(assembler.transform(test)).select(label, "predictions")
        return evaluate_classification(scored, metric, label, "predictions", average=average).first()["score"]

    return score


def search(
    panel: DataFrame,
    features: Sequence[str],
    label: str,
    ranges: dict,
    n_iter: int,
    n_splits: int,
    rules: StopRules | None = None,
    metric: str = "root_mean_squared_error",
    seed: int = 7,
    parallelism: int = 2,
    startup_trials: int = 5,
    score: Callable = gbt_fold_score,
) -> SearchResult:
    """Random search over ``ranges``. ``panel`` has ``fold_block`` and should be materialised.

    Trials run ``parallelism`` at a time; a trial is pruned when its running mean is worse than the
    median of the earlier waves' trials at the same fold. Rules look at the trials in their order.
    """
    rules = rules or StopRules()
    rng = random.Random(seed)
    ranges = usable_ranges(ranges)
    samples = [draw(ranges, rng) for _ in range(n_iter)]
    history: list[list[float]] = []
    result = SearchResult({}, float("nan"))

    def run(params: dict, seen: list[list[float]]):
        scores, means = [], []
        for fold in range(n_splits):
            s = score(panel, features, label, params, fold, metric, seed)
            if s is None:
                continue
            scores.append(s)
            means.append(sum(scores) / len(scores))
            peers = [h[len(means) - 1] for h in seen if len(h) >= len(means)]
            if len(seen) >= startup_trials and peers and rules.better(median(peers), means[-1]):
                return None, means, True
        return (means[-1] if means else None), means, False

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        for start in range(0, n_iter, max(1, parallelism)):
            wave = samples[start : start + max(1, parallelism)]
            seen = list(history)  # what a wave compares with does not depend on which trial ends first
            for offset, (value, means, pruned) in enumerate(pool.map(lambda p, seen=seen: run(p, seen), wave)):
                params = wave[offset]
                history.append(means)
                result.trials.append((start + offset, params, value, pruned))
                if value is not None and (not result.params or rules.better(value, result.score)):
                    result.params, result.score = params, value
                if rules.stop(value, pruned):
                    return result
    return result


def stop_trials(
    log: DataFrame,
    keys: Sequence[str],
    patience: int,
    threshold: float,
    mode: str = "min",
    trial: str = "trial",
    score: str = "score",
    pruned: str = "pruned",
    width: int = 4096,
) -> DataFrame:
    """For many studies at once: the first trial at which each stopping rule fires, null if never.

    Running bests and streaks are kept inside segments of trial numbers and carried across them.
    Trials are numbered 0, 1, 2, ... within a study.
    """
    keys = list(keys)
    sign = 1.0 if mode == "min" else -1.0
    rows = (
        log.withColumn(SEGMENT, segment_of(F.col(trial), width))
        .withColumn("_s", F.when(~F.col(pruned), F.col(score) * sign))
        .withColumn("_kept", F.when(~F.col(pruned), F.col(trial)))
    )
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(trial)
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)

    def carried(df: DataFrame, **aggs) -> DataFrame:
        small = df.groupBy(*keys, SEGMENT).agg(*[a.alias(n) for n, (a, _) in aggs.items()])
        small = small.select(
            *keys, SEGMENT, *[fold(n).over(earlier(keys)).alias(n) for n, (_, fold) in aggs.items()]
        )
        return df.join(small, [*keys, SEGMENT])

    runs = carried(rows, _c_best=(F.min("_s"), F.min), _c_kept=(F.max("_kept"), F.max), _c_first=(F.min("_kept"), F.min))
    runs = runs.withColumns(
        {
            "_best0": F.least(F.min("_s").over(before), F.col("_c_best")),
            "_best": F.least(F.min("_s").over(upto), F.col("_c_best")),
            "_last_kept": F.greatest(F.max("_kept").over(upto), F.col("_c_kept")),
        }
    )
    improved = F.col("_s").isNotNull() & (F.col("_best0").isNull() | (F.col("_s") < F.col("_best0")))
    runs = runs.withColumn("_up", F.when(improved, F.col(trial)))
    runs = carried(runs, _c_up=(F.max("_up"), F.max))
    last_up = F.greatest(F.max("_up").over(upto), F.col("_c_up"))
    runs = runs.withColumn("_last_up", last_up)
    waited = F.col(trial) - F.col("_last_up")
    streak = F.col(trial) - F.coalesce("_last_kept", F.lit(-1))
    first = {
        "no_improvement": waited >= patience,
        "pruned_in_a_row": streak >= patience,
        "past_threshold": F.col("_best") < threshold * sign,
    }
    out = runs.groupBy(*keys).agg(*[F.min(F.when(c, F.col(trial))).alias(n) for n, c in first.items()])
    return out.withColumn("stop_trial", F.least(*first))

"""Metrics, validation, scaling, regression, boosted trees, search, attributions, streams."""

import json
import time

import numpy as np
import pytest
from helpers import START, hours
from pyspark.sql import functions as F

from seriesloom.functions import metrics
from seriesloom.operators import boosted, evaluate, linear, scaling, search, split, validate
from seriesloom.operators.segments import POSITION, SERIES_ROWS
from seriesloom.plans import predict, train
from seriesloom.schema import PREDICTIONS, REGISTRY

T = ["latitude", "longitude", "target_variable"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(3):
        n = 600 if k == 0 else 150
        for t in hours(n):
            a, b = rng.normal(10, 3), rng.normal(-2, 1)
            rows.append((41.0 + k, 2.0, "v", t, a, b, 7.0, 100 + 2 * a - 3 * b + rng.normal(0, 0.5 + k)))
    schema = (
        "latitude double, longitude double, target_variable string, timestamp timestamp_ntz,"
        " a double, b double, c double, value double"
    )
    return spark.createDataFrame(rows, schema).repartition(4).cache()


def least_squares(x, y):
    design = np.column_stack([np.ones(len(x)), x])
    return np.linalg.lstsq(design, y, rcond=None)[0]


def test_accuracy_rule(spark):
    rows = [(10.0, 5.0), (0.0, 1.0), (0.0, 0.0), (-2.0, -3.0), (10.0, 30.0), (None, 1.0)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, y double, p double")
    got = frame.orderBy("i").select(metrics.forecast_accuracy(F.col("y"), F.col("p"))).collect()
    assert [r[0] for r in got] == [50.0, 0.0, None, 100.0, 0.0, None]


def test_flags_and_suggestions(spark):
    rows = [(0.0,), (1.0,), (1.5,)]
    flag = validate.validation_flag(F.col("r"), F.lit(-1.0), F.lit(1.0))
    frame = spark.createDataFrame(rows, "r double")
    assert [r[0] for r in frame.select(flag).collect()] == [1, 1, 0]
    either = validate.validation_flag(F.col("r"), F.lit(-1.0), F.lit(1.0), "any")
    assert [r[0] for r in frame.select(either).collect()] == [1, 1, 1]
    value = validate.suggested_value(F.lit(5.0), F.lit(7.0), flag, F.lit(90.0), 85.0)
    assert [r[0] for r in frame.select(value).collect()] == [5.0, 5.0, 7.0]


def test_regression_metrics(spark):
    y, p = np.array([1.0, 2.0, 4.0, 8.0]), np.array([1.5, 2.0, 3.0, 9.0])
    frame = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(y, p)], "k string, y double, p double")
    row = evaluate.evaluate_regression(frame, ["k"], "y", "p").first()
    mse = np.mean((y - p) ** 2)
    assert row["mean_squared_error"] == pytest.approx(mse)
    assert row["root_mean_squared_error"] == pytest.approx(np.sqrt(mse))
    assert row["mean_absolute_error"] == pytest.approx(np.mean(abs(y - p)))
    assert row["r2"] == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    with pytest.raises(NotImplementedError):
        metrics.regression_metric("other", F.col("y"), F.col("p"))


def test_classification_scores(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 2)] + [(0, 2)]
    frame = spark.createDataFrame(pairs, "y int, p int")
    row = evaluate.classification_scores(evaluate.confusion_matrix(frame, [], "y", "p"), []).first()
    assert row["accuracy"] == pytest.approx(8 / 12)
    assert row["balanced_accuracy"] == pytest.approx((5 / 8 + 3 / 4) / 2)
    f1 = {0: 2 * 5 / (2 * 5 + 3), 1: 2 * 3 / (2 * 3 + 2 + 1), 2: 0.0}
    assert row["f1_macro"] == pytest.approx(np.mean(list(f1.values())))
    assert row["f1_binary"] == pytest.approx(f1[1]) and row["f1_micro"] == pytest.approx(8 / 12)
    assert row["f1_weighted"] == pytest.approx((f1[0] * 8 + f1[1] * 4) / 12)
    by_name = evaluate.evaluate_classification(frame, "f1_score", "y", "p", average="macro").first()["score"]
    assert by_name == pytest.approx(row["f1_macro"])
    with pytest.raises(NotImplementedError):
        evaluate.evaluate_classification(frame, "auc", "y", "p")


def test_scaler(spark, panel):
    one = spark.createDataFrame([("k", v, 4.0) for v in (1.0, 2.0, 3.0)], "k string, x double, c double")
    fit = scaling.scale_fit(one, ["k"], ["x", "c"])
    got = {r["name"]: (r["mean"], r["std"]) for r in scaling.scaler_rows(fit, ["k"]).collect()}
    assert got["x"] == pytest.approx((2.0, 0.81650), abs=1e-5) and got["c"] == (4.0, 1.0)
    fit = scaling.scale_fit(panel, T, ["a", "value"])
    back = scaling.inverse_scale(scaling.scale_transform(panel, T, ["a", "value"], fit), T, {"a": "a", "value": "value"}, fit)
    gap = back.join(panel.withColumnRenamed("a", "a0"), [*T, "timestamp"]).agg(F.max(F.abs(F.col("a") - F.col("a0")))).first()[0]
    assert gap < 1e-9


def test_polynomial_names(spark):
    frame = spark.createDataFrame([(2, 3.0)], "a int, b double")
    out, names = scaling.with_polynomial(frame, ["a", "b"], bias=True)
    assert names == ["1", "a", "b", "a^2", "a b", "b^2"]
    assert [float(v) for v in out.select(*[f"`{n}`" for n in names]).first()] == [1, 2, 3, 4, 6, 9]


def test_linear_fit_equals_least_squares(panel):
    fits = linear.linear_fit(panel, T, ["a", "b", "c"], "value").collect()
    pdf = panel.toPandas()
    for r in fits:
        g = pdf[pdf["latitude"] == r["latitude"]]
        want = least_squares(g[["a", "b"]].to_numpy(), g["value"].to_numpy())
        np.testing.assert_allclose([r["intercept"], *r["coefficients"][:2]], want, rtol=1e-8)
        assert abs(r["coefficients"][2]) < 1e-8  # a constant column gets nothing


def test_folds_from_sums_equal_folds_from_rows(panel):
    blocked = split.with_fold_block(panel, T, 4).cache()
    fits = linear.linear_fit(blocked, T, ["a", "b"], "value", "fold_block")
    sums = {(r["latitude"], r["fold"]): r["score"] for r in linear.fold_scores(fits, T).collect()}
    rows = linear.fold_row_scores(blocked, fits, T, ["a", "b"], "value", "root_mean_squared_error")
    rows = {(r["latitude"], r["fold"]): r["score"] for r in rows.collect()}
    assert sums.keys() == rows.keys() and len(sums) == 12
    for k in sums:
        assert sums[k] == pytest.approx(rows[k], rel=1e-8)
    pdf = blocked.toPandas()
    g = pdf[pdf["latitude"] == 41.0].sort_values("timestamp")
    n = len(g) // 5
    for f in range(4):
        cut = len(g) - (4 - f) * n
        w = least_squares(g[["a", "b"]].to_numpy()[:cut], g["value"].to_numpy()[:cut])
        e = g["value"].to_numpy()[cut : cut + n] - (w[0] + g[["a", "b"]].to_numpy()[cut : cut + n] @ w[1:])
        assert sums[(41.0, f)] == pytest.approx(np.sqrt(np.mean(e**2)), rel=1e-8)


def settings(**kw):
    return train.TrainSettings(**{"cv_splits": 3, "n_iter": 2, **kw})


def test_train_register_predict(spark, panel):
    empty = spark.createDataFrame([], REGISTRY)
    cfg = settings(model_names=[train.LINEAR, train.POLYNOMIAL, "mlpregressor"])
    rows = train.train_and_register(spark, panel, ["a", "b"], "value", empty, cfg, START)
    reg = rows.cache()
    got = reg.collect()
    assert len(got) == 6 and {r["model_version"] for r in got} == {1}
    assert all(r["model_forecast_accuracy"] > 95 for r in got)
    lin = next(r for r in got if r["model_name"] == train.LINEAR and r["latitude"] == 41.0)
    assert set(lin["feature_importances"]) == {"a", "b"} and lin["model_features_count"] == 2
    again = train.targets_to_train(panel.withColumn("model_type", F.lit("autoval_reg")), reg, F.lit(START), 7)
    assert again.count() == 0
    linear_only = reg.where(F.col("model_name") == train.LINEAR)
    records = predict.predict_and_validate(panel, linear_only, "value", update_date=START)
    assert records.columns == PREDICTIONS.names and records.count() == panel.count()
    scored = predict.score_with_registry(panel, linear_only, "value")
    pdf = scored.where("latitude = 41.0").toPandas().sort_values("timestamp")
    cut = len(pdf) - 60
    w = least_squares(pdf[["a", "b"]].to_numpy()[:cut], pdf["value"].to_numpy()[:cut])
    np.testing.assert_allclose(pdf["predictions"], w[0] + pdf[["a", "b"]].to_numpy() @ w[1:], rtol=1e-8)


def test_unknown_model_name():
    with pytest.raises(KeyError):
        settings(params={}).model_kind("linear_regression")
    assert settings().model_kind("polynomial") == train.POLYNOMIAL


def test_boosted_search_and_importance(spark, panel):
    blocked = split.with_fold_block(panel, T, 2).drop(POSITION, SERIES_ROWS).cache()
    ranges = {"n_estimators": [2, 4], "max_depth": [2, 3], "learning_rate": [0.1, 0.5], "reg_alpha": [0, 9]}
    found = search.search(blocked, ["a", "b"], "value", ranges, 3, 2, search.StopRules(5), parallelism=2)
    assert len(found.trials) == 3 and found.score == min(t[2] for t in found.trials)
    assert found.log(spark).count() == 3
    model = boosted.fit_gbt(panel, ["a", "b"], "value", {"n_estimators": 4, "max_depth": 3})
    few = panel.where("latitude > 41.5").limit(40)
    phi = boosted.attributions(model, few, [*T, "timestamp"], panel, ["a", "b"], permutations=4).cache()
    # Each row's attributions add up to its prediction less the mean of its drawn background rows.
    mean = {r["feature"]: r["importance"] for r in boosted.mean_attribution(phi).collect()}
    assert set(mean) == {"a", "b"} and mean["a"] > mean["b"] > 0
    assert phi.count() == 80
    with pytest.raises(KeyError):
        boosted.to_mllib({"other": 1})


def test_attributions_add_up(spark, panel):
    """With one background row the walk ends give the sum exactly."""
    model = boosted.fit_gbt(panel, ["a", "b"], "value", {"n_estimators": 3, "max_depth": 2})
    rows, back = panel.limit(5).cache(), panel.orderBy("timestamp", "latitude").limit(1).cache()
    phi = boosted.attributions(model, rows, [*T, "timestamp"], back, ["a", "b"], permutations=3)
    total = phi.groupBy(*T, "timestamp").agg(F.sum("phi").alias("s"))
    base = boosted.score_model(model, back).first()["predictions"]
    got = boosted.score_model(model, rows).join(total, [*T, "timestamp"]).collect()
    assert len(got) == 5
    for r in got:
        assert r["s"] == pytest.approx(r["predictions"] - base, abs=1e-9)


def test_pruning_and_order():
    seen = []

    def score(panel, features, label, params, fold, metric, seed):
        seen.append((params["x"], fold))
        return float(params["x"] + fold)

    found = search.search(None, [], "", {"x": [0, 1000]}, 12, 3, search.StopRules(50), parallelism=1, score=score)
    assert found.score == min(s for _, _, s, pruned in found.trials if not pruned)
    assert any(pruned for *_, pruned in found.trials)
    assert len(seen) < 36


def test_pruning_does_not_depend_on_timing():
    def score(panel, features, label, params, fold, metric, seed):
        time.sleep(0.002 * (params["x"] % 5))
        return float(params["x"] + fold)

    runs = [
        search.search(None, [], "", {"x": [0, 1000]}, 16, 3, search.StopRules(50), parallelism=4, score=score).trials
        for _ in range(3)
    ]
    assert runs[0] == runs[1] == runs[2] and any(pruned for *_, pruned in runs[0])


def squares(spark):
    """The value is a square, which no line fits."""
    rng = np.random.default_rng(1)
    rows = [(41.0 + k, 2.0, "v", t, float(a)) for k in range(2) for t, a in zip(hours(200), rng.normal(0, 3, 200))]
    df = spark.createDataFrame(rows, "latitude double, longitude double, target_variable string, timestamp timestamp_ntz, a double")
    return df.withColumn("value", F.col("a") * F.col("a") + 10).cache()


def test_a_polynomial_winner_scores_by_its_terms(spark):
    panel, empty = squares(spark), spark.createDataFrame([], REGISTRY)
    cfg = settings(model_names=[train.LINEAR, train.POLYNOMIAL])
    reg = train.train_and_register(spark, panel, ["a"], "value", empty, cfg, START).cache()
    out = predict.score_with_registry(panel, reg, "value").cache()
    assert {r["model_name"] for r in out.select("model_name").distinct().collect()} == {train.POLYNOMIAL}
    assert out.count() == panel.count()
    assert out.agg(F.max(F.abs(F.col("predictions") - F.col("value")))).first()[0] < 1e-6
    with pytest.raises(ValueError, match="a model needs"):
        predict.score_with_registry(panel.withColumnRenamed("a", "b"), reg, "value")


def test_a_boosted_winner_scores_every_row(spark, tmp_path):
    panel, empty = squares(spark), spark.createDataFrame([], REGISTRY)
    ranges = {"n_estimators": [20, 20], "max_depth": [4, 4], "learning_rate": [0.3, 0.3]}
    cfg = settings(model_names=[train.LINEAR, train.BOOSTED], n_iter=1, params={train.LINEAR: {}, train.BOOSTED: ranges})
    reg = train.train_and_register(spark, panel, ["a"], "value", empty, cfg, START, str(tmp_path)).cache()
    assert json.loads(reg.where("model_path is not null").first()["model_parameters"])["max_depth"] == 4
    out = predict.score_with_registry(panel, reg, "value").cache()
    assert out.count() == panel.count() and out.where("predictions is null").count() == 0
    assert {r[0] for r in out.select("model_name").distinct().collect()} == {train.BOOSTED}
    error = out.agg(F.avg(F.abs(F.col("predictions") - F.col("value")))).first()[0]
    assert error < 2
    # One model for the target, scaled for each series; a mixed registry scores each row by its own series' model.
    mixed = reg.where("(latitude = 41.0) = (model_path is null)")
    kinds = predict.score_with_registry(panel, mixed, "value").groupBy("latitude", "model_name").count().collect()
    assert {(r["latitude"], r["model_name"], r["count"]) for r in kinds} == {(41.0, train.LINEAR, 200), (42.0, train.BOOSTED, 200)}


def test_a_series_without_a_model_fails_the_job(spark):
    panel, empty = squares(spark), spark.createDataFrame([], REGISTRY)
    reg = train.train_and_register(spark, panel, ["a"], "value", empty, settings(), START).cache()
    with pytest.raises(Exception, match="no usable model"):
        predict.score_with_registry(panel, reg.where("latitude = 41.0"), "value").collect()


@pytest.mark.parametrize("bad", [{"learning_rate": 0.0}, {"learning_rate": 1.5}, {"max_depth": 31}, {"reg_alpha": 2.0}])
def test_parameters_without_effect_are_refused(bad):
    with pytest.raises(ValueError):
        boosted.to_mllib(bad)
    assert boosted.to_mllib({"reg_lambda": 0, "learning_rate": 1}) == {"stepSize": 1.0}


def test_attributions_draw_from_the_whole_background(spark, panel):
    model = boosted.fit_gbt(panel, ["a", "b"], "value", {"n_estimators": 2, "max_depth": 2})
    phi = boosted.attributions(model, panel, [*T, "timestamp"], panel, ["a", "b"], permutations=1, per_bucket=30)
    total = phi.groupBy(*T, "timestamp").agg(F.sum("phi").alias("s"))
    scored = boosted.score_model(model, panel).join(total, [*T, "timestamp"])
    # Prediction less attributions is the prediction of the row that was drawn: many different ones, right on average.
    drawn = scored.select((F.col("predictions") - F.col("s")).alias("v")).agg(F.avg("v"), F.count("v")).first()
    mean = boosted.score_model(model, panel).agg(F.avg("predictions")).first()[0]
    assert drawn[1] == panel.count() and drawn[0] == pytest.approx(mean, abs=0.6)


def test_wide_sums_equal_single_sums(spark, panel, monkeypatch):
    wide, names = scaling.with_polynomial(split.with_fold_block(panel, T, 3), ["a", "b", "c"])
    want = {r["latitude"]: r for r in linear.linear_fit(wide, T, names, "value", "fold_block").collect()}
    monkeypatch.setattr(linear, "UNROLLED", 1)
    got = {r["latitude"]: r for r in linear.linear_fit(wide, T, names, "value", "fold_block").collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r["n"] == want[k]["n"] and len(r["folds"]) == 3
        for a, b in zip(r["folds"], want[k]["folds"]):
            assert a["sse"] == pytest.approx(b["sse"], rel=1e-6) and a["n_test"] == b["n_test"]

"""Ordered operators: hand-made rows, and pandas as brute force with segments far smaller than a series."""

import math

import numpy as np
import pandas as pd
import pytest
from helpers import START, by_series, gappy, hours, same, series, to_spark, values
from pyspark.sql import functions as F

from seriesloom.operators import grid, impute, lags, quantiles, reshape, segments, smoothing, split


@pytest.fixture(scope="module")
def pdf():
    return gappy(hot=4)  # one series holds over half of all rows


@pytest.fixture(scope="module")
def df(spark, pdf):
    return to_spark(spark, pdf).cache()


def pandas_by_series(pdf, fn):
    return {
        k: fn(g.sort_values("timestamp").set_index("timestamp")["value"].astype(float)).to_numpy()
        for k, g in pdf.groupby("k")
    }


def test_interpolation_micro(spark):
    times = [hours(6)[i] for i in (0, 1, 3, 4, 5)]
    out = impute.interpolate_time(series(spark, [None, 1.0, None, 4.0, None], times=times), ["k"], ["value"])
    assert values(out) == [None, 1.0, 3.0, 4.0, 4.0]


@pytest.mark.parametrize("width", ["7h", "30D"])
def test_interpolation_is_exact_across_segments(df, pdf, width):
    got = by_series(impute.interpolate_time(df, ["k"], ["value"], width=width))
    same(got, pandas_by_series(pdf, lambda s: s.interpolate("time")))


def test_position_interpolation_and_fills(df, pdf):
    same(
        by_series(impute.interpolate_linear(df, ["k"], ["value"], width="1D")),
        pandas_by_series(pdf, lambda s: s.interpolate("linear")),
    )
    same(by_series(impute.forward_fill(df, ["k"], ["value"], width="5h")), pandas_by_series(pdf, lambda s: s.ffill()))
    same(by_series(impute.backward_fill(df, ["k"], ["value"], width="5h")), pandas_by_series(pdf, lambda s: s.bfill()))
    same(
        by_series(impute.fill_chain(df, ["k"], ["value"], width="1D")),
        pandas_by_series(pdf, lambda s: s.interpolate("time").bfill().ffill().fillna(0)),
    )


def test_all_null_series_becomes_zero(spark):
    assert values(impute.fill_chain(series(spark, [None, None]), ["k"], ["value"])) == [0.0, 0.0]
    assert values(impute.fill_chain(series(spark, []), ["k"], ["value"])) == []


def test_positions(df, pdf):
    placed = segments.with_positions(df, ["k"], width="3h")
    got = by_series(placed, segments.POSITION)
    for k, n in pdf.groupby("k").size().items():
        assert list(got[k]) == list(range(1, n + 1))
    assert {r["k"]: r["n"] for r in placed.groupBy("k").agg(F.max(segments.SERIES_ROWS).alias("n")).collect()} == dict(
        pdf.groupby("k").size()
    )


def test_complete_axis(spark):
    at = hours(1200)
    rows = series(spark, [1.0, 2.0, 3.0], times=[at[0], at[5], at[1100]])
    out = grid.complete_axis(rows, ["k"], width="1D")
    assert out.count() == 1101
    assert out.where("value is not null").count() == 3
    assert out.select("timestamp").distinct().count() == 1101


@pytest.mark.parametrize("rows,block", [(3, 4), (100, 128)])
def test_smoothing(df, pdf, rows, block):
    filled = impute.fill_chain(df, ["k"], ["value"]).withColumn("predictions", F.col("value") - 40)
    got = by_series(smoothing.smooth_predictions(filled, ["k"], rows=rows, width="2D", block=block), "predictions")
    base = by_series(filled, "predictions")
    want = {k: pd.Series(v).clip(lower=0).rolling(rows).mean().bfill().ffill().to_numpy() for k, v in base.items()}
    same(got, want)


def test_smoothing_micro(spark):
    def run(v, rows):
        return values(smoothing.smooth_predictions(series(spark, v), ["k"], "value", rows=rows))

    assert run([1.0, 2.0, 3.0, 4.0], 3) == [2.0, 2.0, 2.0, 3.0]
    assert run([1.0] * 99, 100) == [None] * 99


def test_lags(df, pdf):
    got = lags.lag_features(df.na.fill(7.0), ["k"], "value", [1, 5], block=8)
    pdf = pdf.assign(value=pdf["value"].fillna(7.0)).sort_values(["k", "timestamp"])
    for k in (1, 5):
        pdf[f"lag_{k}"] = pdf.groupby("k")["value"].shift(k).round(2)
    same(by_series(got, "lag_5"), {k: g["lag_5"].to_numpy() for k, g in pdf.dropna().groupby("k")})


def test_half_even_rounding(spark):
    from seriesloom.functions.numbers import round_half_even

    v = [0.125, 0.375, 10.595, 2.675]
    got = spark.createDataFrame([(x,) for x in v], "x double").select(round_half_even(F.col("x"), 2)).collect()
    assert [r[0] for r in got] == list(np.round(v, 2))
    assert got[0][0] == 0.12


def brute_pacf(x, nlags):
    """Yule-Walker per order, denominators n - k."""
    x = np.asarray(x) - np.mean(x)
    n = len(x)
    g = np.array([x[k:] @ x[: n - k] / (n - k) for k in range(nlags + 1)])
    out = [1.0]
    for k in range(1, nlags + 1):
        toeplitz = g[np.abs(np.subtract.outer(range(k), range(k)))]
        out.append(np.linalg.solve(toeplitz, g[1 : k + 1])[-1])
    return np.array(out)


def test_partial_autocorrelation(spark):
    rng = np.random.default_rng(3)
    x = [0.0]
    for _ in range(299):
        x.append(0.7 * x[-1] + rng.normal())
    row = lags.select_lags(series(spark, x), ["k"], "value", nlags=10, block=16, width="1D").first()
    want = brute_pacf(x, 10)
    np.testing.assert_allclose(row["pacf"], want, atol=1e-9)
    assert row["lags"] == [k for k in range(1, 11) if abs(want[k]) >= 0.2]


def test_lags_of_constant_and_short_series(spark):
    constant = lags.select_lags(series(spark, [2.0] * 30), ["k"], "value", nlags=5).first()
    assert constant["lags"] == []
    short = lags.select_lags(series(spark, [1.0, 5.0, 2.0, 8.0]), ["k"], "value", nlags=5).first()
    assert short["n_lags"] == 1


def test_split_and_folds(spark):
    out = split.train_test_split(series(spark, [1.0] * 105), ["k"], 0.1, width="1D")
    assert out.where("split = 'test'").count() == 11
    folds = split.time_series_folds(series(spark, [float(i) for i in range(1, 12)]), ["k"], 3).collect()
    got = {(r["fold"], r["role"]): [] for r in folds}
    for r in folds:
        got[(r["fold"], r["role"])].append(int(r["value"]))
    tests = {0: [6, 7], 1: [8, 9], 2: [10, 11]}
    for f, t in tests.items():
        assert sorted(got[(f, "test")]) == t
        assert sorted(got[(f, "train")]) == list(range(1, t[0]))


@pytest.mark.parametrize("n", [1, 2, 5, 39, 41, 399, 401, 5000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.lognormal(3, 2, n), 1)
    x[: n // 3] = x[0]  # a third of all rows share one value
    frame = spark.createDataFrame([("a", float(v)) for v in x], "k string, value double").repartition(4)
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["probability"]: r["quantile"] for r in quantiles.exact_quantiles(frame, ["k"], "value", ps).collect()}
    np.testing.assert_allclose([got[p] for p in ps], np.quantile(x, ps), rtol=1e-12)


def test_quantiles_of_many_rows(spark):
    frame = spark.range(200_000).select(
        F.lit("a").alias("k"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(5) * 100).alias("value")
    ).cache()
    x = frame.toPandas()["value"]
    row = quantiles.quartiles(frame, ["k"], "value").first()
    np.testing.assert_allclose([row["q1"], row["q3"]], np.quantile(x, [0.25, 0.75]), rtol=1e-12)


def test_quartile_micro(spark):
    frame = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 10.0)], "k string, value double")
    row = quantiles.quartiles(frame, ["k"], "value").first()
    assert (row["q1"], row["q3"], row["iqr"]) == (1.75, 4.75, 3.0)


def test_unpivot_undoes_pivot(spark):
    rows = [(START, 1.0, 2.0, v, x) for v, x in (("a", 1.5), ("b", None), ("c", 3.0))]
    long = spark.createDataFrame(
        rows, "timestamp timestamp_ntz, latitude double, longitude double, variable_code string, value double"
    )
    wide = reshape.pivot_wide(long, ["a", "b", "c"])
    back = reshape.unpivot_long(wide, ["timestamp", "latitude", "longitude"], ["a", "b", "c"])
    assert sorted(map(str, back.collect())) == sorted(map(str, long.select(*back.columns).collect()))


def test_points_come_in_pages(spark):
    frame = series(spark, [float(i) for i in range(100)]).withColumn("variable_code", F.lit("v"))
    pages = reshape.series_points(frame, ["k", "variable_code"], page_rows=24).orderBy("page_start").collect()
    assert [r["n_points"] for r in pages] == [24, 24, 24, 24, 4]
    assert [p["value"] for r in pages for p in r["points"]] == [float(i) for i in range(100)]


def test_column_checks(spark):
    frame = spark.createDataFrame([(1, 2)], "A int, b int")
    assert reshape.check_columns(frame, ["a", "B"]).columns == ["a", "B"]
    with pytest.raises(ValueError):
        reshape.check_columns(frame, ["b", "a"])
    assert reshape.matching_columns(frame, ["^b"]).columns == ["b"]
    assert reshape.first_of_each_name(["a", "b", "a"]) == ["a", "b"]


def test_duplicate_predictions_fail(spark):
    row = (1.0, 2.0, START, "valor_a", 1.0)
    schema = "latitude double, longitude double, timestamp timestamp_ntz, target_variable string, predictions double"
    once = reshape.pivot_predictions(spark.createDataFrame([row], schema), ["a"], measures=["predictions"])
    assert once.first()["predictions_a"] == 1.0
    with pytest.raises(Exception, match="duplicate prediction rows"):
        reshape.pivot_predictions(spark.createDataFrame([row, row], schema), ["a"], measures=["predictions"]).collect()


def test_no_window_without_a_partition_and_one_shuffle_of_the_rows(df):
    plan = impute.fill_chain(df, ["k"], ["value"])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "], [k#" in line
    assert "PythonUDF" not in plan and "CartesianProduct" not in plan
    assert math.isfinite(len(plan))

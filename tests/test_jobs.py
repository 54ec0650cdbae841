"""Stored tables end to end: dense and skewed input, re-runs, streams that continue."""

from datetime import timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from helpers import START, by_series, same, to_spark
from pyspark.sql import functions as F

from seriesloom.functions import dates
from seriesloom.operators import impute, segments
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.operators.smoothing import smooth_predictions
from seriesloom.plans import predict, preprocess, train
from seriesloom.schema import PREDICTIONS, SERIES
from seriesloom.session import FREES_SHUFFLES, materialize, materialize_alone, shared_dir
from seriesloom.sources import sinks, tables
from seriesloom.streaming import jobs

UPDATED = "2024-02-01 00:00:00"


def test_width_follows_the_densest_series(spark):
    """One series holds most rows, a second apart; the others are hourly."""
    hot = spark.range(20_000).select(
        F.lit("hot").alias("k"),
        (F.lit(START) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id"))).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("value"),
    )
    calm = spark.range(200).select(
        F.concat(F.lit("c"), F.col("id") % 2).alias("k"),
        (F.lit(START) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz").alias("timestamp"),
        F.col("id").cast("double").alias("value"),
    )
    rows = materialize(hot.unionByName(calm))
    width = segments.suggest_width(rows, ["k"], "timestamp", 1000)
    assert width == "10min"
    placed = segments.with_segment(rows, "timestamp", width)
    assert placed.groupBy("k", segments.SEGMENT).count().agg(F.max("count")).first()[0] <= 1000
    pdf = rows.toPandas()
    want = {
        k: g.sort_values("timestamp").set_index("timestamp")["value"].interpolate("time").to_numpy()
        for k, g in pdf.groupby("k")
    }
    same(by_series(impute.interpolate_time(rows, ["k"], ["value"], width=width)), want)
    assert segments.suggest_width(rows.limit(0), ["k"], "timestamp") == "1min"


def observations(spark, hours, seed=0):
    rng = np.random.default_rng(seed)
    rows = [
        (START + timedelta(hours=h), 41.0 + s, 2.0, v, float(np.round(rng.normal(10, 3), 2)))
        for s in range(2)
        for v in ("precipitation", "wind")
        for h in range(hours)
        if h in (0, hours - 1) or rng.random() > 0.4
    ]
    return spark.createDataFrame(
        rows, "timestamp timestamp_ntz, latitude double, longitude double, variable_code string, value double"
    )


def test_preprocess_and_weekly_rerun(spark, tmp_path):
    root, obs = str(tmp_path), materialize(observations(spark, 400))
    preprocess.run_preprocess(spark, root, obs, UPDATED)
    stored = spark.read.parquet(f"{root}/features").drop("month")
    assert stored.count() == 2 * 2 * 400 + 2 * 4 * 400
    before = materialize(stored)
    end = START + timedelta(hours=399)
    preprocess.rolling_week_rerun(spark, root, obs, end, UPDATED)
    after = spark.read.parquet(f"{root}/features").select(*before.columns)
    assert after.count() == before.count()
    # Observed hours keep their values; only a gap at the very edge of the week may be filled anew.
    assert after.join(obs, ["timestamp", *SERIES, "value"], "left_semi").count() == obs.count()
    marks = spark.read.parquet(f"{root}/marks")
    assert {r["timestamp"] for r in marks.collect()} == {end}
    assert tables.target_variable(after).first()[0] == "precipitation"


def test_feature_stream_continues_and_equals_batch(spark, tmp_path):
    root = str(tmp_path)
    cents = observations(spark, 30)
    cents = materialize(cents.withColumn("timestamp", F.date_trunc("day", "timestamp").cast("timestamp_ntz")))
    first, rest = cents.where("latitude < 41.5"), cents
    for part in (first, rest):
        part.write.mode("append").parquet(f"{root}/in")
        stream = jobs.read_files(spark, f"{root}/in", cents.schema, 1)
        out = jobs.stream_features(spark, stream, f"{root}/out", f"{root}/checkpoint", UPDATED, late="90 days")
    keys = ["timestamp", *SERIES]
    want = first.unionByName(rest).groupBy(*keys).agg(F.avg("value").alias("want"))
    got = out.join(want, keys, "full")
    assert got.where("value is null or want is null or abs(value - want) > 1e-9").count() == 0
    assert got.count() == want.count()


def test_gaps_over_whole_segments(spark):
    at = [0, 1, 500, 900]
    pdf = pd.DataFrame(
        [("a", START + timedelta(hours=h), float(h) if h in at else np.nan) for h in range(950)],
        columns=["k", "timestamp", "value"],
    )
    got = by_series(impute.interpolate_time(to_spark(spark, pdf), ["k"], ["value"], width="6h"))
    same(got, {"a": np.minimum(np.arange(950.0), 900.0)})


def test_jobs_leave_no_intermediate_tables(spark, tmp_path):
    shared = Path(shared_dir(spark))
    obs = materialize(observations(spark, 48))
    before = set(shared.iterdir())
    preprocess.run_preprocess(spark, str(tmp_path), obs, UPDATED)
    assert set(shared.iterdir()) == before
    assert spark.read.parquet(f"{tmp_path}/features").count() > 0


def test_a_run_from_the_marks_fills_the_gap_before_it(spark, tmp_path):
    """Hours 0, 1, 10, 11, 12 of one series: a full run has 13 hours, and so have two runs."""
    rows = [(START + timedelta(hours=h), 41.0, 2.0, "wind", float(h)) for h in (0, 1, 10, 11, 12)]
    obs = spark.createDataFrame(
        rows, "timestamp timestamp_ntz, latitude double, longitude double, variable_code string, value double"
    )
    preprocess.run_preprocess(spark, f"{tmp_path}/full", obs, UPDATED)
    preprocess.run_preprocess(spark, f"{tmp_path}/parts", obs.limit(2), UPDATED)
    marks = materialize(spark.read.parquet(f"{tmp_path}/parts/marks"))
    preprocess.run_preprocess(spark, f"{tmp_path}/parts", obs, UPDATED, marks)
    full, parts = (spark.read.parquet(f"{tmp_path}/{x}/features") for x in ("full", "parts"))
    assert full.where("variable_code = 'wind'").count() == 13
    assert full.exceptAll(parts.select(*full.columns)).count() == 0 and parts.count() == full.count()


def test_a_run_from_the_marks_fills_gaps_of_any_length(spark, tmp_path):
    """One series is silent for over 30 days before the mark, which another one of its location sets: two runs equal one."""
    hours = [("wind", h) for h in (0, 1000, 1005)] + [("rain", h) for h in (0, 1, 1010)]
    rows = [(START + timedelta(hours=h), 41.0, 2.0, name, float(h)) for name, h in hours]
    obs = spark.createDataFrame(
        rows, "timestamp timestamp_ntz, latitude double, longitude double, variable_code string, value double"
    )
    preprocess.run_preprocess(spark, f"{tmp_path}/full", obs, UPDATED)
    preprocess.run_preprocess(spark, f"{tmp_path}/parts", obs.where("value <= 1000"), UPDATED)
    marks = materialize(spark.read.parquet(f"{tmp_path}/parts/marks"))
    preprocess.run_preprocess(spark, f"{tmp_path}/parts", obs, UPDATED, marks)
    full, parts = (spark.read.parquet(f"{tmp_path}/{x}/features") for x in ("full", "parts"))
    assert full.where("variable_code = 'rain'").count() == 1011
    assert full.exceptAll(parts.select(*full.columns)).count() == 0 and parts.count() == full.count()


def test_rows_without_time_are_refused_and_without_key_left_out(spark):
    schema = "k string, timestamp timestamp_ntz, value double"
    bad = spark.createDataFrame([("a", START, 2.0), ("a", None, 1.0)], schema)
    odd = spark.createDataFrame([("a", START, 2.0), (None, START, 1.0)], schema)
    for run in (lambda df: segments.with_positions(df, ["k"]), lambda df: impute.interpolate_time(df, ["k"], ["value"])):
        with pytest.raises(Exception, match="a row without timestamp"):
            run(bad).collect()
        assert [r.k for r in run(odd).collect()] == ["a"]


def test_a_null_group_has_quantiles(spark):
    rows = [(g, v, float(i)) for g, v in (("a", 1), (None, 1), (None, None)) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, v int, x double")
    got = {(r.g, r.v, r.probability): (r.n, r["quantile"]) for r in exact_quantiles(df, ["g", "v"], "x", [0.25, 0.5]).collect()}
    assert got == {(g, v, p): (7, 6 * p) for g, v in (("a", 1), (None, 1), (None, None)) for p in (0.25, 0.5)}


def test_saves_check_and_sort_columns(spark, tmp_path):
    marks = spark.createDataFrame(
        [(START, 1.0, 2.0, "x", START)],
        "UPDATE_DATE timestamp_ntz, longitude double, latitude double, data_type string, timestamp timestamp_ntz",
    )
    sinks.save_table(spark, str(tmp_path), "marks", marks)
    saved = spark.read.parquet(f"{tmp_path}/marks").first()
    assert (saved.latitude, saved.longitude, saved.update_date) == (2.0, 1.0, START)
    for wrong in (marks.drop("longitude"), marks.withColumn("more", F.lit(1))):
        with pytest.raises(ValueError):
            sinks.save_table(spark, str(tmp_path), "marks", wrong)


def test_a_range_reaches_the_scan(spark, tmp_path):
    observations(spark, 100).write.parquet(f"{tmp_path}/obs")
    stop = START + timedelta(hours=50)
    ranges = spark.createDataFrame(
        [(41.0, 2.0, START, stop), (42.0, 2.0, stop, stop)],
        "latitude double, longitude double, start_date timestamp_ntz, end_date timestamp_ntz",
    )
    found = dates.within(spark.read.parquet(f"{tmp_path}/obs"), ranges)
    bounds = {r.latitude: (r.a, r.b) for r in found.groupBy("latitude").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect()}
    assert bounds[41.0][0] == START and bounds[41.0][1] <= stop and bounds.get(42.0, (stop, stop)) == (stop, stop)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThanOrEqual(timestamp" in plan


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def hourly_panel(spark, n=150):
    rng = np.random.default_rng(3)
    rows = [
        (41.0 + s, 2.0, v, START + timedelta(hours=h), float(h % 24), float(np.round(10 + h % 24 + rng.normal(), 2)))
        for s in range(2)
        for v in ("precipitation", "wind")
        for h in range(n)
    ]
    return spark.createDataFrame(
        rows, "latitude double, longitude double, target_variable string, timestamp timestamp_ntz, a double, value double"
    )


def test_stored_steps_leave_no_shuffle_files(spark, tmp_path):
    """The shuffles of a step go with it: a job's disk does not grow with its number of steps."""
    rows = materialize(hourly_panel(spark))
    (key,) = FREES_SHUFFLES
    setting, before = spark.conf.get(key), shuffle_files(spark)
    moved = rows.repartition(4, "timestamp")
    assert materialize(moved).count() == rows.count()
    assert materialize_alone(spark, lambda: materialize(moved).repartition(3, "a")).count() == rows.count()
    sinks.save_table(spark, str(tmp_path), "features", rows.select(
        "timestamp", "latitude", "longitude", F.col("target_variable").alias("variable_code"), "value",
        F.lit(UPDATED).cast("timestamp_ntz").alias("update_date"),
    ))
    # Counting is no stored step: of its shuffles only single rows stay until the driver collects its garbage.
    left = {f.split("_")[1] for f in shuffle_files(spark) - before if f.endswith(".data")}
    assert len(left) <= 4, left
    assert spark.conf.get(key) == setting


def test_intermediate_tables_go_with_their_step(spark):
    shared, rows = Path(shared_dir(spark)), hourly_panel(spark, 5)
    before = set(shared.iterdir())
    out = materialize_alone(spark, lambda: materialize(rows).where("a > 1"))
    assert len(set(shared.iterdir()) - before) == 1 and out.count() == rows.where("a > 1").count()


def test_jobs_write_whole_records_without_moving_them(spark, tmp_path, monkeypatch):
    """Records are neither sorted nor shuffled to be saved, and smoothing moves rows without what is made at the end."""
    from seriesloom.operators import merge, smoothing

    written, stored = [], []
    write, store = merge._overwrite_partitions, smoothing.materialize
    monkeypatch.setattr(merge, "_overwrite_partitions", lambda df, *a: (written.append(df), write(df, *a)))
    monkeypatch.setattr(smoothing, "materialize", lambda df, **o: (stored.append(df), store(df, **o))[1])
    panel = materialize(hourly_panel(spark))
    cfg = train.TrainSettings(cv_splits=3)
    train.run_train_job(spark, str(tmp_path), panel, ["a"], "value", cfg, UPDATED)
    predict.run_predict_job(spark, str(tmp_path), panel, "value", UPDATED, f"{tmp_path}/out")
    wide = [df for df in written if "suggested_value" in df.columns]
    assert len(wide) == 2
    for df in wide:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan and "Scan parquet" in plan
    assert [set(df.columns) & {"suggested_value", "data_quality_percentage", "validation_boolean"} for df in stored] == [set()]
    saved, out = spark.read.parquet(f"{tmp_path}/predictions"), spark.read.parquet(f"{tmp_path}/out")
    assert saved.count() == out.count() == panel.count()
    # The stored predictions are smoothed; flags and suggestions come from the predictions as they were scored.
    scored = predict.score_with_registry(panel, spark.read.parquet(f"{tmp_path}/registry"), "value")
    want = smooth_predictions(scored, ["latitude", "longitude", "target_variable"]).withColumnRenamed("predictions", "smooth")
    keys = ["timestamp", "latitude", "longitude", "target_variable"]
    raw = scored.select(*keys, F.col("predictions").alias("raw"))
    both = saved.join(want.select(*keys, "smooth"), keys).join(raw, keys)
    assert both.count() == panel.count()
    assert both.where("abs(predictions - smooth) > 1e-9 or suggested_value not in (raw, real_value)").count() == 0


def test_a_stored_batch_with_a_key_twice_changes_nothing(spark, tmp_path):
    panel = hourly_panel(spark, 3)
    rows = materialize(panel.select(*[
        (F.col(f.name) if f.name in panel.columns else F.lit("1" if f.name == "model_version" else None)).cast(f.dataType).alias(f.name)
        for f in PREDICTIONS.fields
    ]))
    sinks.save_table(spark, str(tmp_path), "predictions", rows.limit(4), stored=True)
    twice = materialize(rows.union(rows.limit(1)))
    for root in (tmp_path, tmp_path / "new"):
        with pytest.raises(Exception, match="duplicate key in batch"):
            sinks.save_table(spark, str(root), "predictions", twice, stored=True)
    assert spark.read.parquet(f"{tmp_path}/predictions").count() == 4 and not (tmp_path / "new").exists()
    for _ in range(2):
        sinks.save_table(spark, str(tmp_path), "predictions", rows.withColumn("predictions", F.lit(5.0)), stored=True)
    assert spark.read.parquet(f"{tmp_path}/predictions").where("predictions = 5").count() == rows.count()


def test_smoothing_fills_from_other_blocks(spark):
    """Gaps wider than a block, at the start, inside and at the end; a series without a value stays empty."""
    rng = np.random.default_rng(5)
    base = {"a": rng.normal(5, 1, 60), "b": rng.normal(5, 1, 41), "c": np.full(30, np.nan), "d": rng.normal(5, 1, 1)}
    for k, a, b in (("a", 0, 13), ("a", 20, 37), ("b", 25, 41)):
        base[k][a:b] = np.nan
    times = {k: [START + timedelta(hours=i) for i in range(len(v))] for k, v in base.items()}
    pdf = pd.DataFrame([(k, t, x) for k, v in base.items() for t, x in zip(times[k], v)], columns=["k", "timestamp", "value"])
    for n, block in ((1, 4), (3, 4), (3, 8), (6, 2)):
        got = by_series(smooth_predictions(to_spark(spark, pdf), ["k"], "value", rows=n, block=block))
        same(got, {k: pd.Series(v).clip(lower=0).rolling(n).mean().bfill().ffill().to_numpy() for k, v in base.items()})

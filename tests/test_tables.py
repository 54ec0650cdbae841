"""Scans, upserts, marks, registry rules, configuration, dates."""

from datetime import datetime, timedelta

import pytest
from helpers import START
from pyspark.sql import functions as F

from seriesloom.functions import calendar, dates, params, text
from seriesloom.operators import merge, registry, search
from seriesloom.schema import FEATURES, FEATURES_KEY, RUN_CONFIG, RUN_CONFIG_KEY, raw_hourly
from seriesloom.sources import jdbc, landed, sinks, tables

D1, D2 = datetime(2024, 2, 1), datetime(2024, 2, 2)


def features(spark, *rows):
    return spark.createDataFrame([(START + timedelta(hours=h), 41.0, 2.0, v, x, d) for h, v, x, d in rows], FEATURES)


def key(df):
    return sorted((r["timestamp"], r["variable_code"], r["value"], r["update_date"]) for r in df.collect())


def test_upsert(spark):
    old = features(spark, (0, "a", 1.0, D1), (1, "a", 2.0, D1))
    new = features(spark, (1, "a", 5.0, D2), (2, "a", 6.0, D2))
    once = merge.upsert(old, new, FEATURES_KEY)
    assert [r[2] for r in key(once)] == [1.0, 5.0, 6.0]
    assert key(merge.upsert(once, new, FEATURES_KEY)) == key(once)
    with pytest.raises(Exception, match="duplicate key"):
        merge.upsert(old, new.union(new), FEATURES_KEY).collect()


def test_partial_upsert_keeps_created_date(spark):
    old = spark.createDataFrame([(START, "training", "n_iter", "1", D1, D1)], RUN_CONFIG)
    new = spark.createDataFrame(
        [(START, "training", "n_iter", "2", D2, D2), (START, "training", "x", "3", D2, D2)], RUN_CONFIG
    )
    rows = {r["parameter_code"]: r for r in merge.upsert(old, new, RUN_CONFIG_KEY, ["parameter_value", "update_date"]).collect()}
    assert (rows["n_iter"]["parameter_value"], rows["n_iter"]["created_date"], rows["n_iter"]["update_date"]) == ("2", D1, D2)
    assert rows["x"]["created_date"] == D2


def test_upsert_table_touches_only_its_partitions(spark, tmp_path):
    root = str(tmp_path)
    sinks.save_table(spark, root, "features", features(spark, (0, "a", 1.0, D1), (0, "b", float("nan"), D1)))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "features" / "variable_code=b").rglob("*.parquet")}
    for _ in range(2):
        sinks.save_table(spark, root, "features", features(spark, (0, "a", 3.0, D2), (900, "a", 4.0, D2)))
    got = {(r["variable_code"], r["timestamp"]): r["value"] for r in spark.read.parquet(f"{root}/features").collect()}
    assert got[("a", START)] == 3.0 and got[("b", START)] is None and len(got) == 3
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "features" / "variable_code=b").rglob("*.parquet")}


def test_marks(spark):
    rows = features(spark, (0, "a", 1.0, D1), (5, "b", 1.0, D1))
    marks = merge.marks_of(rows, "engineered_data", D1)
    assert marks.first()["timestamp"] == START + timedelta(hours=5)
    later = features(spark, (5, "a", 1.0, D1), (6, "a", 1.0, D1))
    assert merge.since_mark(later, marks, "engineered_data").count() == 1
    assert merge.since_mark(later, marks, "other").count() == 2
    moved = merge.advance_marks(marks, later, "engineered_data", D2).first()
    assert moved["timestamp"] == START + timedelta(hours=6)


def test_filters_reach_the_files(spark, tmp_path):
    sinks.save_table(spark, str(tmp_path), "features", features(spark, (0, "a", 1.0, D1), (0, "b", 2.0, D1)))
    stored = spark.read.parquet(f"{tmp_path}/features")
    scan = tables.feature_scan(stored, 41.0, 2.0, "2024-01-01", "2024-01-02", ["a"], ordered=False)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(variable_code" in plan and "RLIKE" in plan.split("PartitionFilters")[1]
    assert "GreaterThanOrEqual(latitude,40.9995)" in plan and "GreaterThanOrEqual(timestamp" in plan


def test_range_rules(spark):
    rows = features(spark, (0, "a", 1.0, D1), (24, "a", 2.0, D1), (30, "a", 3.0, D1))
    assert tables.in_range(rows, "2024-01-01", "None").count() == 3
    assert tables.in_range(rows, "2024-01-01", "2024-01-02").count() == 2
    assert tables.in_range(rows, "2024-01-01", "2024-01-02", end_inclusive_day=True).count() == 3


def test_landed_arrays(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"latitude": 1.5, "longitude": 2.5, "start_epoch": 0, "end_epoch": 10800, "interval_s": 3600,'
        ' "a": [1.0, 2.0, 3.0], "b": [4.0, 5.0]}\n'
    )
    read = landed.read_landed(spark, str(tmp_path), ["a", "b"])
    assert read.columns == raw_hourly(["a", "b"]).names
    rows = landed.expand_hourly_arrays(read, ["a", "b"]).orderBy("timestamp").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1.0, 4.0), (2.0, 5.0), (3.0, None)]
    assert rows[0]["timestamp"] == datetime(1970, 1, 1) and rows[0]["latitude"] == 1.5


def test_seasons(spark):
    days = [(3, 20), (3, 21), (6, 20), (6, 21), (9, 22), (9, 23), (12, 20), (12, 21), (2, 29)]
    frame = spark.createDataFrame([(i, datetime(2024, m, d)) for i, (m, d) in enumerate(days)], "i int, t timestamp_ntz")
    got = [r[0] for r in frame.orderBy("i").select(calendar.season(F.col("t"))).collect()]
    assert got == [0, 1, 1, 2, 2, 3, 3, 0, 0]
    monday = frame.limit(1).select(calendar.FEATURES["weekday"](F.lit("2024-01-01").cast("timestamp_ntz"))).first()[0]
    assert monday == 0
    with pytest.raises(ValueError):
        calendar.with_calendar(frame, "t", ["minute"])


def test_dates(spark):
    one = spark.range(1)
    back = one.select(dates.shift_date(F.lit("2024-10-10").cast("timestamp_ntz"), 100, "backward", "1D")).first()[0]
    assert back == datetime(2024, 7, 2)
    assert dates.frequency_seconds("15min") == 900 and dates.frequency_seconds("D") == 86400
    for bad in (lambda: dates.frequency_seconds("15"), lambda: dates.shift_date(F.lit(1), 1, "up", "1D")):
        with pytest.raises(ValueError):
            bad()
    schema = "latitude double, longitude double, timestamp timestamp_ntz"
    at = spark.createDataFrame([(1.0, 1.0, START), (2.0, 2.0, START + timedelta(hours=2))], schema)
    done = spark.createDataFrame([(2.0, 2.0, START)], schema)
    got = {r["latitude"]: r["start_date"] for r in dates.resolve_prediction_range(at, done, 2, "60min").collect()}
    assert got == {1.0: START - timedelta(hours=24), 2.0: START - timedelta(hours=4)}
    with pytest.raises(Exception, match="no high-water mark"):
        dates.resolve_prediction_range(done.limit(0), done, 2, "60min").collect()


def test_text(spark):
    frame = spark.createDataFrame([("15min", "None"), ("D", "x")], "f string, m string")
    got = frame.select(text.number_part(F.col("f")), text.unit_part(F.col("f")), text.missing(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [(15, "min", None), (1, "D", "x")]
    nan = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.0)], "i int, v double")
    assert [r["v"] for r in text.nan_to_null(nan).orderBy("i").collect()] == [None, None, 1.0]


def test_seed_config_parses(spark):
    assert len(params.SEED_CONFIG) == 24
    rows = [(START, s, c, v, D1, D1) for s, c, v in params.SEED_CONFIG]
    frame = spark.createDataFrame(rows, RUN_CONFIG)
    from seriesloom.operators.reshape import pivot_config

    codes = sorted({c for _, c, _ in params.SEED_CONFIG})
    typed = params.parse_config(pivot_config(frame, codes)).where("stage = 'training'").first()
    assert typed["cv_splits"] == 10 and typed["test_size"] == 0.1 and typed["auto_training"] is True
    assert typed["xgboost_regression_params"]["xgbregressor__max_depth"] == ["2", "8"] and typed["direction"] == "backward"
    assert typed["mlpregressor_params"]["mlpregressor__hidden_layer_sizes"] == ["[10]", "[512]"]
    assert typed["linear_regression_params"] == {} and typed["model_names"][2] == "mlpregressor"
    assert params.parameters_of_models(frame).count() == 3


def test_literals(spark):
    wanted = {"{'a': [(10,), (512,)]}": '{"a": [[10], [512]]}', "None": "null", "(1, [None, 'x'])": '[1, [null, "x"]]', "true": "true", "False": "false", " 7": "7", '"t"': '"t"'}
    assert {k: params.json_of(k) for k in wanted} == wanted and params.json_of(None) is None
    row = spark.createDataFrame([("None", "('a', 'b')", None)], "cv_splits string, model_names string, n_iter string")
    assert tuple(params.parse_config(row).first()) == (None, ["a", "b"], None)
    for bad in ("[1, 2", "__import__('os')", "ten", "1.5.2"):
        with pytest.raises(ValueError):
            params.json_of(bad)
    for code, bad in (("cv_splits", "ten"), ("cv_splits", "[1]"), ("model_names", "{}"), ("a_params", "[1]")):
        with pytest.raises(Exception, match="(?i)cannot be cast|not a literal|malformed"):
            params.parse_config(spark.createDataFrame([(bad,)], f"{code} string")).collect()


def models(spark, *rows):
    return spark.createDataFrame(
        [("autoval_reg", 1.0, 2.0, t, v, d, n, a) for t, v, d, n, a in rows],
        "model_type string, latitude double, longitude double, target_variable string, model_version int,"
        " model_date timestamp_ntz, model_name string, model_forecast_accuracy double",
    )


def test_registry_rules(spark):
    reg = models(
        spark,
        ("a", 1, D2 - timedelta(days=3), "m", 99.0),
        ("a", 2, D2 - timedelta(hours=5), "m", 80.0),
        ("a", 3, D2, "m", 80.0),
        ("a", 4, D2, "n", 70.0),
    )
    assert registry.most_recent_models(reg).first()["model_version"] == 4
    assert {r["model_version"] for r in registry.best_models_in_window(reg).collect()} == {2, 3}
    assert registry.best_model(reg).first()["model_version"] == 3
    wanted = models(spark, ("a", 0, D1, "", 0.0), ("b", 0, D1, "", 0.0))
    got = {r["target_variable"]: r["model_version"] for r in registry.next_versions(wanted, reg).collect()}
    assert got == {"a": 5, "b": 1}


def test_staleness(spark):
    now = datetime(2024, 3, 10)
    age = {"eight": 8, "seven": 7, "six": 6}
    reg = models(spark, *[(t, 1, now - timedelta(days=n), "m", 1.0) for t, n in age.items()])
    wanted = models(spark, *[(t, 0, D1, "", 0.0) for t in [*age, "none"]])
    due = registry.targets_to_train(wanted, reg, F.lit(now), 7)
    assert {r["target_variable"]: r["reason"] for r in due.collect()} == {
        "none": "untrained", "eight": "stale", "seven": "stale",
    }


def test_stop_rules(spark):
    rules = search.StopRules(patience=2, mode="min")
    assert [rules.stop(s) for s in (5.0, 4.0, 4.0, 4.0)] == [False, False, False, True]
    assert search.StopRules(5, "max", 0.8).stop(0.9) and not search.StopRules(5, "min", 0.8).stop(0.9)
    pruned = search.StopRules(2)
    assert [pruned.stop(None, True) for _ in range(2)] == [False, True]
    scores = [9.0, 8.0, None, 8.5, 7.0, 7.5, None, None, None, 6.0, 1.0]
    log = spark.createDataFrame(
        [("s", i, x, x is None) for i, x in enumerate(scores)], "k string, trial bigint, score double, pruned boolean"
    )
    for width in (2, 4096):
        row = search.stop_trials(log, ["k"], 3, 2.0, width=width).first()
        assert (row["no_improvement"], row["pruned_in_a_row"], row["past_threshold"], row["stop_trial"]) == (7, 8, 10, 7)


def test_jdbc_options():
    assert jdbc.jdbc_url("postgresql", "db", "x", 5432) == "jdbc:postgresql://db:5432/x"
    assert jdbc.jdbc_url("sqlite", database="/tmp/x.db") == "jdbc:sqlite:/tmp/x.db"
    with pytest.raises(NotImplementedError):
        jdbc.jdbc_url("other", "h")
    options = jdbc.read_options("u", "t", partition_column="latitude", bounds=(0, 90), partitions=16)
    assert options["numPartitions"] == "16" and options["upperBound"] == "90" and "user" not in options
    with pytest.raises(ValueError):
        jdbc.read_options("u", "t", partition_column="latitude")


def test_locations_match_to_three_decimals(spark):
    rows = spark.createDataFrame([(41.38899993896484, 2.1589999198913574), (41.389, 2.159), (41.39, 2.159)], "latitude double, longitude double")
    assert tables.at_location(rows, 41.389, 2.159).count() == 2
    assert tables.at_location(rows, "41.3894").count() == 2

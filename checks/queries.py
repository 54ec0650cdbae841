"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import domain as D
from checks.domain import PRIORITIES, TARGET, UPDATED, VARIABLES, ntz
from seriesloom.functions import calendar, dates, metrics, numbers, params, text
from seriesloom.operators import (
    boosted,
    evaluate,
    histogram,
    impute,
    lags,
    linear,
    merge,
    quantiles,
    registry,
    reshape,
    scaling,
    search,
    smoothing,
    split,
    validate,
)
from seriesloom.plans import predict, preprocess, train
from seriesloom.schema import FEATURES_KEY, LOCATION, PREDICTIONS_KEY, REGISTRY_KEY, RUN_CONFIG_KEY, SERIES
from seriesloom.session import materialize, scratch_path
from seriesloom.sources import landed, sinks, tables
from seriesloom.streaming import jobs
from seriesloom.streaming import lags as stream_lags

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order, so they are compared rounded. The small shift keeps exact
    ties away from the rounding border; + 0.0 turns a negative zero into zero."""
    shift = D.TIE_SHIFT * 10.0**-digits
    return df.withColumns({c: F.round(F.col(c) + shift, digits) + F.lit(0.0) for c in columns})


# ---------------------------------------------------------------- jobs


@query
def preprocess_features(s, d):
    o = materialize(D.obs(s, d))
    return preprocess.preprocess_observations(o, UPDATED, bounds=D.bounds(o))


@query
def rolling_week_rerun(s, d):
    recent = materialize(preprocess.trailing_days(D.obs(s, d), "2024-01-30 23:00:00", 7))
    return preprocess.preprocess_observations(recent, UPDATED)


@query
def preprocess_incremental(s, d):
    """Two runs over the observations, the second from the marks of the first, equal one run over all."""
    root, o = scratch_path(s, "incremental"), materialize(D.obs(s, d))
    preprocess.run_preprocess(s, root, o.where(F.col("timestamp") < ntz("2024-01-20 00:00:00")), UPDATED)
    marks = materialize(s.read.parquet(f"{root}/marks"))
    preprocess.run_preprocess(s, root, o, UPDATED, marks)
    return s.read.parquet(f"{root}/features").select("timestamp", *SERIES, "value", "update_date")


# ---------------------------------------------------------------- sources


def responses(s, d):
    """Landed responses of all variables: one per site and day, arrays from the hours observed."""
    o = D.filled(s, d)
    day = dates.day_of(F.col("timestamp"))
    epoch = F.unix_seconds(F.col("timestamp").cast("timestamp"))

    def values(v):
        hit = F.when(F.col("variable_code") == v, F.struct("timestamp", "value"))
        return F.transform(F.array_sort(F.collect_list(hit)), lambda p: p["value"]).alias(v)

    return o.groupBy(*LOCATION, day.alias("day")).agg(
        F.min(epoch).alias("start_epoch"),
        (F.max(epoch) + 3600).alias("end_epoch"),
        F.lit(3600).alias("interval_s"),
        *[values(v) for v in VARIABLES],
    )


@query
def expand_hourly_arrays(s, d):
    # Every third site sends short arrays.
    r = responses(s, d).withColumn(
        "view",
        F.when(F.round(F.col("latitude") * 100).cast("int") % 3 == 0, F.slice("view", 1, 5)).otherwise(F.col("view")),
    )
    return landed.expand_hourly_arrays(r, VARIABLES)


@query
def preprocess_landed(s, d):
    return preprocess.preprocess_landed(responses(s, d), VARIABLES, UPDATED)


@query
def feature_scan(s, d):
    return tables.feature_scan(D.obs(s, d), 41.01, 2.01, "2024-01-05 00:00:00", "2024-01-20 00:00:00")


@query
def feature_scan_regex(s, d):
    return tables.feature_scan(D.obs(s, d), variables=["ick", "sign"])


@query
def feature_scan_locations(s, d):
    big = D.table(s, d, "customer").where(F.col("c_acctbal") > 5000)
    at = big.select(*[v.alias(k) for k, v in D.coordinates(D.site_of("c_custkey")).items()])
    return tables.feature_scan(D.obs(s, d), locations=at, start="2024-01-05", end="2024-01-06", ordered=False)


@query
def predictions_latest(s, d):
    return tables.predictions_scan(D.preds(s, d), targets=["click", "view"])


@query
def predictions_range(s, d):
    return tables.predictions_scan(D.preds(s, d), start="2024-01-10 00:00:00", end="2024-01-12 05:00:00")


@query
def config_scan(s, d):
    return tables.config_scan(D.config(s, d), ntz("1995-01-04 21:00:00"), "training")


@query
def registry_scan(s, d):
    return tables.registry_scan(
        D.registry(s, d), "linear_regression", "autoval_reg", "URG|LOW",
        columns=["model_date", *LOCATION, "target_variable", "model_version"],
    )


@query
def registry_scan_date(s, d):
    return tables.registry_scan(
        D.registry(s, d), "linear_regression", "autoval_reg", "HIGH", model_date=ntz("1999-01-16 00:00:00.5"),
        columns=["model_date", *LOCATION, "target_variable", "model_version"],
    )


@query
def registry_importances(s, d):
    r = D.registry(s, d).withColumn(
        "feature_importances",
        F.create_map(F.lit("a"), F.col("model_forecast_accuracy"), F.lit("b"), F.col("model_metric_test_value")),
    )
    return tables.registry_importances(r)


@query
def last_processed(s, d):
    return tables.last_processed(tables.distinct_coordinates(D.obs(s, d)), D.marks(s, d), "engineered_data")


@query
def distinct_coordinates(s, d):
    return tables.distinct_coordinates(D.obs(s, d))


@query
def distinct_variables(s, d):
    return tables.distinct_variables(D.obs(s, d))


@query
def target_variable(s, d):
    return tables.target_variable(D.obs(s, d), "r")


@query
def partner_coordinate(s, d):
    return tables.partner_coordinate(D.obs(s, d), latitude=41.01)


@query
def date_bounds(s, d):
    return tables.date_bounds(D.obs(s, d))


@query
def models_of_config(s, d):
    c = D.config(s, d).withColumn("model_id", F.concat_ws("_", "stage", F.year("timestamp").cast("string")))
    return tables.models_of_config(c, "1995-01-04 21:00:00", "prediction_1995")


# ---------------------------------------------------------------- sinks


def batch(s, d):
    """A later batch of features: the last ten days corrected, five days more."""
    o = D.obs(s, d).where(F.col("timestamp") >= ntz("2024-01-20 00:00:00"))
    moved = o.where(F.col("timestamp") >= ntz("2024-01-26 00:00:00")).withColumns(
        {"timestamp": F.col("timestamp") + F.make_dt_interval(F.lit(5)), "value": F.lit(0.5)}
    )
    fixed = o.withColumn("value", F.col("value") + 1)
    later = moved.where(F.col("timestamp") >= ntz("2024-01-31 00:00:00"))
    return fixed.unionByName(later).withColumn("update_date", ntz("2024-02-02 00:00:00"))


def stamped(s, d):
    return D.obs(s, d).withColumn("update_date", ntz(UPDATED))


@query
def upsert_features(s, d):
    return merge.upsert(stamped(s, d), batch(s, d), FEATURES_KEY)


@query
def upsert_features_table(s, d):
    """The same through a partitioned table: write, upsert twice, read."""
    root = scratch_path(s, "features")
    sinks.save_table(s, root, "features", stamped(s, d))
    for _ in range(2):
        sinks.save_table(s, root, "features", batch(s, d))
    return s.read.parquet(f"{root}/features").drop("month")


@query
def upsert_predictions(s, d):
    old = D.preds(s, d).withColumn("update_date", ntz(UPDATED))
    new = (
        old.where(F.hour("timestamp") == 12)
        .withColumns({"predictions": F.lit(1.5), "model_version": F.lit(2), "update_date": ntz("2024-02-02 00:00:00")})
    )
    return merge.upsert(old, new, PREDICTIONS_KEY)


@query
def upsert_registry(s, d):
    old = D.registry(s, d)
    half = old.where(F.col("model_name") == "linear_regression").withColumn("model_forecast_accuracy", F.lit(50.0))
    more = half.withColumn("model_type", F.lit("autoval_clf"))
    return merge.upsert(old, half.unionByName(more), REGISTRY_KEY)


@query
def upsert_config_partial(s, d):
    old = D.config(s, d)
    new = old.where(F.col("parameter_code").isin("n_iter", "direction")).withColumns(
        {"parameter_value": F.lit("9"), "created_date": ntz(UPDATED), "update_date": ntz(UPDATED)}
    )
    fresh = new.where(F.col("parameter_code") == "n_iter").withColumn("parameter_code", F.lit("n_iter_extra"))
    return merge.upsert(old, new.unionByName(fresh), RUN_CONFIG_KEY, ["parameter_value", "update_date"])


@query
def delete_config(s, d):
    return merge.delete_where(D.config(s, d), F.col("timestamp") == ntz("1995-01-04 21:00:00"))


@query
def delete_stored(s, d):
    """Delete from a stored table: one stage loses all its rows, the other some."""
    root = scratch_path(s, "delete")
    sinks.save_table(s, root, "config", D.config(s, d))
    gone = (F.col("stage") == "prediction") | (F.col("timestamp") == ntz("1995-01-04 21:00:00"))
    merge.delete_from_table(s, f"{root}/config", gone, ["stage"])
    return s.read.schema(D.config(s, d).schema).parquet(f"{root}/config")


@query
def high_water_mark(s, d):
    return merge.advance_marks(D.marks(s, d), D.obs(s, d), "engineered_data", "2024-02-03 00:00:00")


@query
def incremental_since_mark(s, d):
    return merge.since_mark(D.obs(s, d), D.marks(s, d), "engineered_data")


@query
def save_features(s, d):
    """Features and marks through their tables; the marks are what the next run reads."""
    root = scratch_path(s, "save")
    long = stamped(s, d)
    sinks.save_features(s, root, long, UPDATED)
    return s.read.parquet(f"{root}/marks").select(*LOCATION, "data_type", "timestamp", "update_date")


@query
def publish_predictions(s, d):
    name = F.concat_ws("/", F.col("latitude").cast("string"), F.col("longitude").cast("string"), "target_variable")
    root = scratch_path(s, "publish")
    rows = materialize(D.preds(s, d).withColumn("target_variable", name))
    for part in range(3):  # the sites in three turns, one after the other
        own = F.pmod(F.round(F.col("latitude") * 100).cast("int"), F.lit(3)) == part
        sinks.publish_predictions(s, rows.where(own), root)
    return s.read.parquet(root).select(*TARGET, "timestamp", "predictions")


@query
def nan_to_null(s, d):
    ratio = F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value"))
    return text.nan_to_null(D.obs(s, d).withColumn("value", ratio))


# ---------------------------------------------------------------- reshaping


@query
def pivot_wide(s, d):
    return reshape.pivot_wide(D.obs(s, d), VARIABLES)


@query
def unpivot_long(s, d):
    return reshape.unpivot_long(reshape.pivot_wide(D.obs(s, d), VARIABLES), [*LOCATION, "timestamp"], VARIABLES)


@query
def align_outer(s, d):
    o = D.obs(s, d)
    return reshape.align_outer({v: o.where(F.col("variable_code") == v) for v in VARIABLES})


@query
def pivot_predictions(s, d):
    p = D.preds(s, d).withColumn("target_variable", F.concat(F.lit("valor_"), "target_variable"))
    real, made = F.col("real_value"), F.col("predictions")
    p = p.withColumns({"data_quality_percentage": made - real, "validation_boolean": (made > real).cast("int"), "suggested_value": F.greatest(real, made)})
    return reshape.pivot_predictions(p, VARIABLES)


@query
def config_pivot(s, d):
    return reshape.pivot_config(D.config(s, d), ["n_iter", "cv_splits", "direction", "batch_size"])


@query
def parse_config(s, d):
    codes = ["n_iter", "test_size", "direction", "auto_training", "model_names", "xgboost_regression_params", "mlpregressor_params"]
    typed = params.parse_config(reshape.pivot_config(D.config(s, d), codes))
    return typed.select(
        "timestamp", "stage", "n_iter", "test_size", "direction",
        F.col("auto_training").cast("int").alias("auto_training"),
        F.array_join("model_names", ",").alias("model_names"),
        F.col("xgboost_regression_params")["xgbregressor__max_depth"][1].cast("double").alias("max_depth_high"),
        F.col("xgboost_regression_params")["xgbregressor__subsample"][0].cast("double").alias("subsample_low"),
        F.col("mlpregressor_params")["mlpregressor__hidden_layer_sizes"][1].alias("layers_high"),
    )


@query
def model_parameters(s, d):
    return params.parameters_of_models(materialize(D.config(s, d)))


@query
def series_points(s, d):
    pages = reshape.series_points(D.obs(s, d), page_rows=100, variables=["click", "view"])
    last = F.get("points", F.size("points") - 1)
    return pages.select(
        *SERIES, "page_start", "n_points", last["timestamp"].alias("last_time"), last["value"].alias("last_value")
    )


# ---------------------------------------------------------------- gaps


@query
def interpolate_time(s, d):
    return impute.interpolate_time(D.grid(s, d), SERIES, ["value"]).select(*SERIES, "timestamp", "value")


@query
def interpolate_linear(s, d):
    # All hours, each at an uneven time: the second half of a day is an hour later. Positions differ from times.
    late = F.make_dt_interval(F.lit(0), F.when(F.hour("timestamp") >= 12, 1).otherwise(0))
    g = D.grid(s, d).withColumn("timestamp", F.col("timestamp") + late)
    return impute.interpolate_linear(g, SERIES, ["value"]).select(*SERIES, "timestamp", "value")


@query
def forward_fill(s, d):
    return impute.forward_fill(D.grid(s, d), SERIES, ["value"]).select(*SERIES, "timestamp", "value")


@query
def backward_fill(s, d):
    return impute.backward_fill(D.grid(s, d), SERIES, ["value"]).select(*SERIES, "timestamp", "value")


@query
def fill_chain(s, d):
    return D.filled(s, d)


@query
def fill_chain_panel(s, d):
    wide = reshape.pivot_wide(D.obs(s, d), VARIABLES)
    return impute.fill_chain(wide, LOCATION, VARIABLES)


@query
def null_counts(s, d):
    return impute.null_counts(reshape.pivot_wide(D.obs(s, d), VARIABLES))


@query
def drop_incomplete(s, d):
    return impute.drop_incomplete(reshape.pivot_wide(D.obs(s, d), VARIABLES))


# ---------------------------------------------------------------- ordered operators


@query
def smooth_predictions(s, d):
    # Some predictions are no numbers or very large: they spoil the windows that hold them and no others.
    bad = F.when(F.hour("timestamp") + F.dayofmonth("timestamp") * 24 == 100, F.lit(float("nan")))
    bad = bad.when(F.hour("timestamp") + F.dayofmonth("timestamp") * 24 == 300, F.lit(1e17))
    out = smoothing.smooth_predictions(D.preds(s, d).withColumn("predictions", bad.otherwise(F.col("predictions"))), TARGET)
    return rounded(out.select(*TARGET, "timestamp", "predictions"), "predictions")


@query
def lag_features(s, d):
    return lags.lag_features(D.filled(s, d), SERIES, "value", [1, 2, 24], block=256)


@query
def acf(s, d):
    cov = lags.autocovariances(D.filled(s, d), SERIES, "value", 50)
    out = cov.select(*SERIES, "n", F.posexplode("autocovariance").alias("lag", "autocovariance"))
    return rounded(out, "autocovariance")


@query
def select_lags(s, d):
    chosen = lags.select_lags(D.filled(s, d), SERIES, "value", nlags=50)
    out = chosen.select(*SERIES, F.posexplode("pacf").alias("lag", "pacf"), "lags")
    kept = F.array_contains("lags", F.col("lag")).cast("int")
    return rounded(out.select(*SERIES, "lag", "pacf", kept.alias("kept")), "pacf")


@query
def supervised_lags(s, d):
    out = lags.supervised_lags(D.grid(s, d), SERIES, "value", 50)
    return out.select(*SERIES, "timestamp", F.size("lags").alias("n_lags"), F.element_at("lag_values", 1).alias("lag_1"))


@query
def train_test_split_time(s, d):
    return split.train_test_split(D.filled(s, d), SERIES, 0.1)


@query
def time_series_folds(s, d):
    folds = split.time_series_folds(D.obs(s, d), SERIES, 10)
    return folds.groupBy(*SERIES, "fold", "role").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )


# ---------------------------------------------------------------- scalars


@query
def calendar_features(s, d):
    e = D.table(s, d, "events").select("event_id", F.col("ts").alias("timestamp"))
    return calendar.with_calendar(e, features=[*calendar.DEFAULT_FEATURES, "day_of_month"])


@query
def season(s, d):
    o = D.table(s, d, "orders")
    return o.groupBy("o_orderdate", calendar.season(F.col("o_orderdate")).alias("season")).agg(F.count("*").alias("n"))


@query
def shift_date(s, d):
    o = D.table(s, d, "orders")
    t = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_custkey") % 24).cast("int"))
    return o.select(
        "o_orderkey",
        dates.shift_date(t, 100, "backward", "1D").alias("days_back"),
        dates.shift_date(t, 35040, "backward", "15min").alias("quarters_back"),
        dates.shift_date(t, 7, "forward", "H").alias("hours_on"),
    )


@query
def resolve_preprocess_ranges(s, d):
    at = tables.last_processed(tables.distinct_coordinates(D.obs(s, d)), D.marks(s, d), "engineered_data")
    return dates.resolve_preprocess_range(at, ntz(UPDATED)).select(*LOCATION, "start_date", "end_date")


@query
def resolve_training_ranges(s, d):
    return dates.resolve_training_range(tables.date_bounds(D.obs(s, d)), start=ntz("2024-01-02 00:00:00"))


@query
def resolve_prediction_ranges(s, d):
    marks = merge.marks_of(D.obs(s, d), "engineered_data", UPDATED)
    done = (
        D.obs(s, d)
        .where(F.round(F.col("latitude") * 100).cast("int") % 2 == 0)
        .where((F.hour("timestamp") < 21) | (F.round(F.col("latitude") * 100).cast("int") % 4 == 0))
    )
    return dates.resolve_prediction_range(marks, merge.marks_of(done, "realtime_predictions", UPDATED), 100, "60min")


@query
def clean_names(s, d):
    p = D.table(s, d, "part")
    loc = F.concat_ws("/", F.lit("bcn"), F.col("p_size").cast("string"))
    raw = F.concat(loc, F.lit("/valor_"), "p_name")
    freq = F.concat(F.col("p_size").cast("string"), F.lit("min"))
    odd = F.when(F.col("p_size") % 5 == 0, "None").when(F.col("p_size") % 5 == 1, "").otherwise(F.col("p_brand"))
    return p.select(
        "p_partkey",
        text.remove_literal(raw).alias("without_valor"),
        text.strip_location(raw, loc).alias("without_location"),
        text.variable_key(F.col("p_size"), F.col("p_partkey"), F.col("p_type"), odd).alias("variable_key"),
        text.number_part(freq).alias("number"),
        text.unit_part(freq).alias("unit"),
        text.safe_name(F.col("p_name")).alias("safe_name"),
        text.missing(odd).alias("normalised"),
    )


@query
def clip_and_round(s, d):
    li = D.table(s, d, "lineitem")
    return li.groupBy(
        numbers.clip(F.when(F.col("l_quantity") > 2, F.col("l_quantity")), 10, 40).alias("clipped"),
        numbers.round_half_even(F.col("l_extendedprice") / 1000, 1).alias("thousands"),
    ).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- metrics and validation


@query
def regression_metrics(s, d):
    li = D.table(s, d, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_quantity") * 2).alias("p"),
    )
    out = evaluate.evaluate_regression(li, ["l_returnflag", "l_linestatus"], "y", "p")
    return rounded(out, *metrics.REGRESSION, "forecast_accuracy", digits=4)


@query
def evaluate_predictions(s, d):
    out = evaluate.evaluate_regression(
        D.preds(s, d), TARGET, names=["mean_absolute_error", "root_mean_squared_error"], zero_actual="floor"
    )
    return rounded(out, "mean_absolute_error", "root_mean_squared_error", "forecast_accuracy")


def labelled(s, d):
    lab = D.table(s, d, "labels")
    return lab.join(D.table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query
def confusion_matrix(s, d):
    return evaluate.confusion_matrix(labelled(s, d), ["lang"], "quality", "toxic")


@query
def classification_metrics(s, d):
    scores = evaluate.classification_scores(evaluate.confusion_matrix(labelled(s, d), ["lang"], "quality", "toxic"), ["lang"])
    return rounded(scores, *[c for c in scores.columns if c not in ("lang", "n")])


@query
def log_loss(s, d):
    p = labelled(s, d).withColumn("p", (F.col("n_chars") % 1001).cast("double") / 1000)
    return rounded(evaluate.evaluate_classification(p, "neg_log_loss", "quality", "p", ["lang"]), "score")


@query
def exact_quartiles(s, d):
    return quantiles.quartiles(D.table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query
def exact_quantiles(s, d):
    q = quantiles.exact_quantiles(D.table(s, d, "orders"), ["o_orderpriority"], "o_totalprice", [0.0, 0.1, 0.5, 0.99, 1.0])
    return rounded(q, "quantile")


@query
def iqr_thresholds(s, d):
    out = validate.iqr_thresholds(D.preds(s, d))
    return rounded(out, "q1", "q3", "lower_threshold", "upper_threshold")


@query
def iqr_thresholds_limited(s, d):
    limits = tables.series_of(D.obs(s, d)).withColumnRenamed("variable_code", "target_variable").withColumns(
        {"lower_limit": F.lit(-40.0), "upper_limit": F.when(F.col("target_variable") != "view", 35.0)}
    )
    out = validate.iqr_thresholds(D.preds(s, d), limits=limits)
    return rounded(out, "q1", "q3", "lower_threshold", "upper_threshold")


@query
def forecast_accuracy(s, d):
    p = D.preds(s, d).withColumn("real_value", F.col("real_value") - 10)
    return p.select(
        *TARGET,
        "timestamp",
        metrics.forecast_accuracy(F.col("real_value"), F.col("predictions")).alias("signed"),
        metrics.forecast_accuracy(F.col("real_value"), F.col("predictions"), True).alias("absolute"),
    )


@query
def validate_predictions(s, d):
    p = D.preds(s, d)
    out = validate.validate(p, validate.iqr_thresholds(p), 60.0)
    return out.select(
        *TARGET, "timestamp", "data_quality_percentage", "validation_boolean", "suggested_value"
    )


@query
def suggested_values(s, d):
    li = D.table(s, d, "lineitem")
    real, pred = F.col("l_extendedprice") / 1000, F.col("l_quantity") * 2
    acc = metrics.forecast_accuracy(real, pred)
    flag = validate.validation_flag(validate.residual(real, pred), F.lit(-20.0), F.lit(20.0))
    out = li.select(
        "l_returnflag", flag.alias("flag"), validate.suggested_value(real, pred, flag, acc, 50.0).alias("suggested")
    )
    return out.groupBy("l_returnflag", "flag").agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("suggested") * 1000).cast("bigint")).alias("suggested_thousandths")
    )


@query
def prediction_records(s, d):
    return validate.prediction_records(D.preds(s, d), accuracy_threshold=60.0, update_date=UPDATED)


# ---------------------------------------------------------------- registry


def wanted(s, d):
    """Every site x priority the orders could have a model for: sites from customers."""
    sites = D.table(s, d, "customer").select(*[v.alias(k) for k, v in D.coordinates(D.site_of("c_custkey")).items()])
    names = F.array(*map(F.lit, [*PRIORITIES, "6-NONE"]))
    return sites.distinct().select(
        F.lit("autoval_reg").alias("model_type"), *LOCATION, F.explode(names).alias("target_variable")
    )


@query
def next_model_version(s, d):
    return registry.next_versions(wanted(s, d), D.registry(s, d))


@query
def most_recent_model(s, d):
    return registry.most_recent_models(D.registry(s, d))


@query
def best_model_in_window(s, d):
    return registry.best_models_in_window(D.registry(s, d), ["model_type", "target_variable"], 1)


@query
def best_model(s, d):
    return registry.best_model(D.registry(s, d), ["model_type", "target_variable"], 30)


@query
def stale_targets(s, d):
    return registry.targets_to_train(wanted(s, d), D.registry(s, d), ntz(D.NOW), 90)


@query
def untrained_targets(s, d):
    return registry.untrained_targets(wanted(s, d), D.registry(s, d))


@query
def models_matching_suffix(s, d):
    return registry.models_matching_suffix(D.registry(s, d), "GENT").select("model_path", "target_variable")


@query
def early_stopping(s, d):
    return search.stop_trials(D.trial_log(s, d), ["study"], 3, 20000.0)


# ---------------------------------------------------------------- models

FEATURE_NAMES = ["lag_1", "lag_2", "lag_24", "hour"]


@query
def scale_fit(s, d):
    fit = scaling.scale_fit(D.filled(s, d), SERIES, ["value"])
    return rounded(scaling.scaler_rows(fit, SERIES), "mean", "std")


@query
def scale_transform(s, d):
    f = D.filled(s, d)
    z = scaling.scale_transform(f, SERIES, ["value"], scaling.scale_fit(f, SERIES, ["value"]))
    return rounded(z, "value")


@query
def inverse_scale(s, d):
    f = D.filled(s, d)
    fit = scaling.scale_fit(f, SERIES, ["value"])
    z = scaling.scale_transform(f, SERIES, ["value"], fit).withColumn("prediction", F.col("value") + 1)
    return rounded(scaling.inverse_scale(z, SERIES, {"value": "value", "prediction": "value"}, fit), "value", "prediction")


@query
def polynomial_features(s, d):
    p = D.table(s, d, "part").select("p_partkey", F.col("p_size").alias("a"), F.col("p_retailprice").alias("b"))
    out, names = scaling.with_polynomial(p, ["a", "b"], bias=True)
    return out.toDF(*[{"1": "bias", "a^2": "aa", "a b": "ab", "b^2": "bb"}.get(c, c) for c in out.columns])


@query
def align_features(s, d):
    p = D.panel(s, d)
    return scaling.align_features(p, ["hour", "lag_2", "lag_7"], [*TARGET, "timestamp"])


def one_lag(s, d):
    return D.panel(s, d, (1,)).select(*TARGET, "timestamp", "lag_1", "value")


@query
def linear_fit(s, d):
    fit = linear.linear_fit(one_lag(s, d), TARGET, ["lag_1"], "value")
    out = fit.select(*TARGET, "n", F.get("coefficients", F.lit(0)).alias("slope"), "intercept")
    return rounded(out, "slope", "intercept")


@query
def linear_cv(s, d):
    blocked = split.with_fold_block(one_lag(s, d), TARGET, 10)
    fits = materialize(linear.linear_fit(blocked, TARGET, ["lag_1"], "value", "fold_block"))  # one row per series
    rmse = linear.fold_scores(fits, TARGET).withColumnRenamed("score", "rmse")
    mae = linear.fold_row_scores(blocked, fits, TARGET, ["lag_1"], "value", "mean_absolute_error")
    out = rmse.join(mae.withColumnRenamed("score", "mae"), [*TARGET, "fold"])
    return rounded(out, "rmse", "mae")


@query
def linear_fold_means(s, d):
    blocked = split.with_fold_block(one_lag(s, d), TARGET, 10)
    fits = materialize(linear.linear_cv(blocked, TARGET, ["lag_1"], "value"))
    means = linear.mean_fold_coefficients(fits, TARGET)
    return rounded(means.join(fits.select(*TARGET, "validation_score"), TARGET), "coefficient", "validation_score")


def scaled_models(s, d, features, rows=None):
    """Per-series models on scaled data, with their scalers."""
    rows = one_lag(s, d) if rows is None else rows
    columns = [*features, "value"]
    fit = scaling.scale_fit(rows, TARGET, columns)
    scaled = scaling.scale_transform(rows, TARGET, columns, fit)
    return linear.linear_fit(scaled, TARGET, features, "value").join(fit, TARGET)


@query
def score_linear(s, d):
    rows = one_lag(s, d)
    out = linear.score_linear(rows, scaled_models(s, d, ["lag_1"], rows), TARGET, ["lag_1", "absent"], "value")
    return rounded(out.select(*TARGET, "timestamp", "value", "predictions"), "predictions")


@query
def linear_importance(s, d):
    rows = one_lag(s, d)
    out = linear.linear_importance(rows, scaled_models(s, d, ["lag_1"], rows), TARGET, ["lag_1"])
    return rounded(out, "importance")


@query
def evaluate_models(s, d):
    rows = one_lag(s, d)
    out = linear.score_linear(rows, scaled_models(s, d, ["lag_1"], rows), TARGET, ["lag_1"], "value")
    return rounded(
        evaluate.evaluate_regression(out, TARGET, "value", "predictions", ["root_mean_squared_error"]),
        "root_mean_squared_error", "forecast_accuracy",
    )


def settings(**changes):
    base = dict(
        model_names=[train.LINEAR, train.POLYNOMIAL],
        n_iter=3,  # trials of a search: the bound that keeps a query short; folds are the configured ten
        params={
            train.LINEAR: {},
            train.POLYNOMIAL: {},
            train.BOOSTED: {"n_estimators": [3, 5], "max_depth": [2, 3], "learning_rate": [0.1, 0.5]},
        },
    )
    return train.TrainSettings(**{**base, **changes})


def empty_registry(s):
    return s.createDataFrame([], train.REGISTRY)


@query
def train_register(s, d):
    """Two kinds of models for every series: fitted, cross-validated, scored, explained, registered."""
    rows = train.train_and_register(
        s, D.panel(s, d), FEATURE_NAMES, "value", empty_registry(s), settings(), "2024-02-01 00:00:00"
    )
    return rows.drop("scaler", "coefficients", "feature_importances")


@query
def train_register_linear(s, d):
    """The linear part alone with one feature, comparable with closed forms."""
    cfg = settings(model_names=[train.LINEAR])
    rows = train.train_and_register(s, one_lag(s, d), ["lag_1"], "value", empty_registry(s), cfg, UPDATED)
    out = rows.select(
        *TARGET, "model_name", "model_version", "model_features_count",
        F.col("model_metric_validation_value").alias("validation"),
        F.col("model_metric_test_value").alias("test"),
        F.col("model_forecast_accuracy").alias("accuracy"),
    )
    return rounded(out, "validation", "test", "accuracy")


@query
def predict_and_validate(s, d):
    """Train, register, score with the registry, validate, smooth."""
    panel = one_lag(s, d)
    cfg = settings(model_names=[train.LINEAR])
    rows = materialize(train.train_and_register(s, panel, ["lag_1"], "value", empty_registry(s), cfg, UPDATED))
    out = predict.predict_and_validate(panel, rows, "value", accuracy_threshold=60.0, update_date=UPDATED)
    measures = ["predictions", "data_quality_percentage", "suggested_value"]
    return rounded(out.select(*TARGET, "timestamp", "real_value", "validation_boolean", *measures), *measures)


@query
def predict_registry_mixed(s, d):
    """Linear and polynomial models of two features compete for every series; each row is scored by its best one."""
    panel = D.panel(s, d, (1, 2)).select(*TARGET, "timestamp", "lag_1", "lag_2", "value")
    cfg = settings()
    rows = materialize(train.train_and_register(s, panel, ["lag_1", "lag_2"], "value", empty_registry(s), cfg, UPDATED))
    out = predict.score_with_registry(panel, rows, "value")
    return out.groupBy(*TARGET, "model_name").agg(F.count("*").alias("n"), F.count("predictions").alias("scored"))


@query
def run_jobs(s, d):
    """The training job and the prediction job on stored tables: the published records."""
    root = scratch_path(s, "jobs")
    panel = one_lag(s, d)
    train.run_train_job(s, root, panel, ["lag_1"], "value", settings(model_names=[train.LINEAR]), UPDATED)
    predict.run_predict_job(s, root, panel, "value", UPDATED, f"{root}/published", accuracy_threshold=60.0)
    out = s.read.parquet(f"{root}/published")
    measures = ["predictions", "data_quality_percentage", "suggested_value"]
    return rounded(out.select(*TARGET, "timestamp", "real_value", "validation_boolean", *measures), *measures)


@query
def run_jobs_in_range(s, d):
    """Training between two dates, then prediction of the range that the feature marks and the look-back give."""
    root = scratch_path(s, "jobs")
    panel, cfg = one_lag(s, d), settings(model_names=[train.LINEAR])
    train.run_train_job(s, root, panel, ["lag_1"], "value", cfg, UPDATED, *D.RANGE)
    marks = panel.select(*LOCATION).distinct().select(
        *LOCATION, F.lit("engineered_data").alias("data_type"), ntz(D.RANGE[1]).alias("timestamp"), ntz(UPDATED).alias("update_date")
    )
    sinks.save_table(s, root, "marks", materialize(marks))
    predict.run_predict_job(
        s, root, panel, "value", UPDATED, f"{root}/published", (D.RANGE_HOURS, "1h", "backward"), accuracy_threshold=60.0
    )
    out = s.read.parquet(f"{root}/published")
    measures = ["predictions", "data_quality_percentage", "suggested_value"]
    return rounded(out.select(*TARGET, "timestamp", "real_value", "validation_boolean", *measures), *measures)


@query
def preprocess_look_back(s, d):
    """A second run that looks two days back behind the marks of the first equals one run over all."""
    root, o = scratch_path(s, "look-back"), materialize(D.obs(s, d))
    preprocess.run_preprocess(s, root, o.where(F.col("timestamp") < ntz("2024-01-20 00:00:00")), UPDATED)
    marks = materialize(s.read.parquet(f"{root}/marks"))
    preprocess.run_preprocess(s, root, o, UPDATED, marks, look_back=(2, "1D", "backward"))
    return s.read.parquet(f"{root}/features").select("timestamp", *SERIES, "value", "update_date")


@query
def job_marks(s, d):
    """The marks and registry versions that the training job leaves behind after two runs, the second with nothing due."""
    root = scratch_path(s, "jobs")
    panel, cfg = one_lag(s, d), settings(model_names=[train.LINEAR])
    for _ in range(2):
        train.run_train_job(s, root, panel, ["lag_1"], "value", cfg, UPDATED)
    saved = s.read.parquet(f"{root}/registry").groupBy(*LOCATION).agg(F.count("*").alias("n_models"), F.max("model_version").alias("version"))
    marks = s.read.parquet(f"{root}/marks").where("data_type = 'training'")
    return marks.join(saved, LOCATION).select(*LOCATION, "timestamp", "n_models", "version")


@query
def tune_classifier(s, d):
    """Search for a classifier of quality from simple text measures, maximising balanced accuracy."""
    lab = D.table(s, d, "labels").join(D.table(s, d, "documents"), "doc_id")
    panel = materialize(
        lab.select(
            "doc_id",
            F.col("quality").cast("double").alias("quality"),
            F.col("n_chars").cast("double").alias("chars"),
            F.size(F.split("text", r"\s+")).cast("double").alias("words"),
            F.regexp_count("text", F.lit(r"\d")).cast("double").alias("digits"),
        )
    )
    found = search.search(
        panel, ["chars", "words", "digits"], "quality", {"n_estimators": [2, 4], "max_depth": [2, 4]}, 3, 2,
        search.StopRules(5, "max", 0.99), "balanced_accuracy", score=search.classifier_fold_score(["doc_id"], 2),
    )
    return found.log(s)


@query
def gbt_train(s, d):
    """Boosted trees on the pooled panel; test scores of every series."""
    cut = materialize(split.train_test_split(D.panel(s, d), TARGET, 0.1))
    model = boosted.fit_gbt(
        cut.where(F.col("split") == "train"), FEATURE_NAMES, "value", {"n_estimators": 5, "max_depth": 3}
    )
    scored = boosted.score_model(model, cut.where(F.col("split") == "test"))
    return evaluate.evaluate_regression(scored, TARGET, "value", "predictions", ["root_mean_squared_error", "r2"])


def calendar_rows(s, d):
    return D.panel(s, d, (1,)).select(*TARGET, "timestamp", "hour", F.weekday("timestamp").cast("double").alias("weekday"), "value")


def calendar_trees(s, d, given):
    model = histogram.fit_trees(calendar_rows(s, d), TARGET, ["hour", "weekday"], "value", given)
    return rounded(model.where("tree = 0").drop("tree"), "gain", "value")


@query
def boosted_stump(s, d):
    """The first tree of every series at once, one split deep."""
    return calendar_trees(s, d, {"n_estimators": 1, "max_depth": 1})


@query
def boosted_depth2(s, d):
    """The first tree of every series, two splits deep, with every regulariser."""
    return calendar_trees(s, d, TREE_OF_DEPTH_2)


@query
def boosted_attributions(s, d):
    """Exact attributions of every row, as the mean size by series and feature."""
    rows, names = calendar_rows(s, d), ["hour", "weekday"]
    model = histogram.fit_trees(rows, TARGET, names, "value", {"n_estimators": 1, "max_depth": 1})
    phi = histogram.attributions(rows, model, TARGET, ["timestamp"], names)
    return rounded(boosted.mean_attribution(phi, TARGET), "importance")


TREE_OF_DEPTH_2 = {
    "n_estimators": 1, "max_depth": 2, "reg_alpha": 3.0, "reg_lambda": 5.0, "max_delta_step": 4.0, "min_split_loss": 2.0,
    "min_child_weight": 20, "learning_rate": 0.1,
}


def search_panel(s, d):
    return materialize(split.with_fold_block(D.panel(s, d), TARGET, 2).drop("_position", "_series_rows"))


@query
def tune_search(s, d):
    cfg = settings()
    found = search.search(
        search_panel(s, d), FEATURE_NAMES, "value", cfg.params[train.BOOSTED], 3, 2, search.StopRules(5)
    )
    return found.log(s)


def trial_facts(log):
    """What holds for any log of a search: its trials in order, and how many of them were scored or pruned."""
    return log.agg(
        F.count("*").alias("n_trials"),
        (F.max("trial") + 1 == F.count("*")).alias("in_order"),
        F.count_if(F.col("pruned") | F.col("score").isNotNull()).alias("n_decided"),
        F.max(F.size("params")).cast("int").alias("n_params"),
    )


@query
def tune_search_facts(s, d):
    return trial_facts(tune_search(s, d))


@query
def tune_classifier_facts(s, d):
    return trial_facts(tune_classifier(s, d))


@query
def gbt_panel_facts(s, d):
    """Rows of every series that the boosted model scores, and that no score is missing or below zero."""
    out = gbt_train(s, d)
    return out.select(*TARGET, "n", (F.col("root_mean_squared_error") >= 0).alias("scored"))


@query
def tree_importance(s, d):
    cut = materialize(split.train_test_split(D.panel(s, d), TARGET, 0.02))
    rows, test = cut.where(F.col("split") == "train"), cut.where(F.col("split") == "test")
    model = boosted.fit_gbt(rows, FEATURE_NAMES, "value", {"n_estimators": 3, "max_depth": 3})
    phi = boosted.attributions(model, test, [*TARGET, "timestamp"], rows, FEATURE_NAMES, permutations=1)
    return boosted.mean_attribution(phi, ["target_variable"])


@query
def train_register_boosted(s, d):
    cfg = settings(model_names=[train.BOOSTED], cv_splits=2, n_iter=2, test_size=0.05)
    rows = train.train_and_register(
        s, D.panel(s, d), FEATURE_NAMES, "value", empty_registry(s), cfg, "2024-02-01 00:00:00",
        scratch_path(s, "models"),
    )
    return rows.drop("scaler", "coefficients", "model_path")


# ---------------------------------------------------------------- streams


@query
def stream_features(s, d):
    schema = D.table(s, d, "events").schema
    root = scratch_path(s, "stream")
    cents = D.cents_of(jobs.read_files(s, f"{d}/events*.parquet", schema))
    rows = cents.withColumn("value", (F.col("cents") / F.lit(100)).cast("decimal(18,2)")).drop("cents")
    out = jobs.stream_features(s, rows, f"{root}/features", f"{root}/checkpoint", UPDATED, late="60 days")
    return rounded(out, "value")


@query
def stream_score(s, d):
    """The panel as files, scored as a stream with models and thresholds made in batch."""
    root = scratch_path(s, "score")
    one_lag(s, d).write.parquet(f"{root}/in")
    rows = s.read.parquet(f"{root}/in")
    models = materialize(
        scaled_models(s, d, ["lag_1"], rows).withColumns(
            {
                "model_date": ntz(UPDATED),
                "model_name": F.lit("linear_regression"),
                "model_type": F.lit("autoval_reg"),
                "model_version": F.lit(1),
            }
        )
    )
    scored = linear.score_linear(rows, models, TARGET, ["lag_1"], "value").withColumn("real_value", F.col("value"))
    bounds = materialize(validate.iqr_thresholds(scored))
    stream = jobs.read_files(s, f"{root}/in", rows.schema)
    out = jobs.stream_score(
        s, stream, models, bounds, ["lag_1"], "value", f"{root}/out", f"{root}/checkpoint", UPDATED, 60.0
    )
    return rounded(
        out.select(*TARGET, "timestamp", "real_value", "predictions", "data_quality_percentage", "validation_boolean"),
        "predictions", "data_quality_percentage",
    )


@query
def stream_lag_scores(s, d):
    """Single observations in three files, some hours late, scored with lags that the stream makes itself."""
    root = scratch_path(s, "lag-scores")
    panel = one_lag(s, d)
    models = scaled_models(s, d, ["lag_1"], panel).select(
        *TARGET,
        ntz(UPDATED).alias("model_date"),
        F.lit("linear_regression").alias("model_name"),
        F.lit("autoval_reg").alias("model_type"),
        F.lit(1).alias("model_version"),
        F.lit(90.0).alias("model_forecast_accuracy"),
        F.array(F.lit("lag_1")).alias("model_feature_names"),
        "scaler",
        "coefficients",
        "intercept",
        *[F.lit(None).cast(kind).alias(c) for c, kind in (("model_path", "string"), ("lower_limit", "double"), ("upper_limit", "double"))],
    )
    models = materialize(models)
    bounds = materialize(validate.iqr_thresholds(predict.score_with_registry(panel, models, "value")))
    rows = D.as_target(D.filled(s, d)).select(*TARGET, "timestamp", "value")
    hour = F.unix_seconds(F.col("timestamp").cast("timestamp")) / 3600
    late = F.pmod(F.xxhash64(*TARGET, "timestamp"), F.lit(6))
    span = rows.agg(F.min(hour).alias("a"), F.max(hour).alias("b")).first()
    part = F.least(F.lit(2), F.floor((hour + late - span.a) / (span.b - span.a + 1) * 3))
    dealt = materialize(rows.withColumn("_part", part))
    for k in range(3):  # the order in which the files appear
        dealt.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = jobs.read_files(s, f"{root}/in", rows.schema, 1)
    out = stream_lags.stream_lag_scores(
        s, stream, lambda: models, bounds, "value", [1], f"{root}/out", f"{root}/checkpoint",
        update_date=UPDATED, accuracy_threshold=60.0, digits=None,
    )
    return rounded(
        out.select(*TARGET, "timestamp", "real_value", "predictions", "data_quality_percentage", "validation_boolean"),
        "predictions", "data_quality_percentage",
    )

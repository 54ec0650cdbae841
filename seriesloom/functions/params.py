"""Typed run parameters stored as literals: numbers, texts, lists, tuples, dictionaries, True, False and None, or the same as JSON."""

from __future__ import annotations

import json
from ast import literal_eval

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters whose name contains one of these stay text.
TEXT_PARAMETERS = ["date_frequency", "direction", "early_stop_mode", "model_metric"]

# Type of each typed parameter.
PARAMETER_TYPES = {
    "start_time_window": "int",
    "day_frequency": "int",
    "model_names": "array<string>",
    "auto_training": "boolean",
    "train_models_older_than": "int",
    "cv_splits": "int",
    "test_size": "double",
    "n_iter": "int",
    "early_stop_patience": "int",
    "early_stop_threshold": "double",
    "n_study_runs": "int",
    "batch_size": "int",
    "forecast_acc_threshold": "double",
}
# Bounds of a search as JSON text each: "100", "0.5", "[512]".
RANGES = "map<string,array<string>>"

# The seed configuration (stage, code, value).
SEED_CONFIG = [
    ("training", "start_time_window", "35040"),
    ("prediction", "start_time_window", "100"),
    ("training", "date_frequency", "15min"),
    ("prediction", "date_frequency", "15min"),
    ("prediction", "day_frequency", "30"),
    ("training", "model_metric", "root_mean_squared_error"),
    ("training", "model_names", '["linear_regression", "xgboost_regression", "mlpregressor"]'),
    ("training", "auto_training", "True"),
    ("training", "train_models_older_than", "7"),
    ("training", "cv_splits", "10"),
    ("training", "test_size", "0.1"),
    ("training", "n_iter", "100"),
    ("training", "early_stop_patience", "10"),
    ("training", "early_stop_mode", "min"),
    ("training", "early_stop_threshold", "0.05"),
    ("training", "n_study_runs", "1"),
    ("training", "linear_regression_params", "{}"),
    (
        "training",
        "xgboost_regression_params",
        '{"xgbregressor__n_estimators":[100, 1000], "xgbregressor__max_depth":[2, 8], '
        '"xgbregressor__learning_rate":[0.0, 0.5], "xgbregressor__min_split_loss":[0, 100], '
        '"xgbregressor__min_child_weight":[100], "xgbregressor__max_delta_step":[0, 100], '
        '"xgbregressor__subsample":[0.2, 1.0], "xgbregressor__reg_alpha":[0, 100], '
        '"xgbregressor__reg_lambda":[0, 100]}',
    ),
    (
        "training",
        "mlpregressor_params",
        '{"mlpregressor__hidden_layer_sizes": [(10,), (512,)], "mlpregressor__alpha": [0.0001], '
        '"mlpregressor__learning_rate_init": [0.0001], "mlpregressor__max_iter": [100, 10000]}',
    ),
    ("training", "direction", "backward"),
    ("prediction", "direction", "backward"),
    ("prediction", "batch_size", "1000"),
    ("training", "forecast_acc_threshold", "85"),
    ("prediction", "forecast_acc_threshold", "85"),
]


def is_text(code: str) -> bool:
    return any(part in code for part in TEXT_PARAMETERS)


def json_of(text: str | None) -> str | None:
    """A literal as JSON; tuples become lists, None becomes null, a null stays one. Any other text is refused."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text))
    except ValueError:
        pass
    try:
        return json.dumps(literal_eval(text.strip()))
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError) as error:
        raise ValueError(f"not a literal: {text!r}") from error


@F.pandas_udf(T.StringType())
def literal_json(values: pd.Series) -> pd.Series:
    """Some tens of rows a run: literals have no parser among the built-in functions."""
    return values.map(json_of, na_action="ignore")


def parse_parameter(value: Column, code: str) -> Column:
    """One parameter of a pivoted configuration as its own type; a text that is no literal, or not of the type, fails the job."""
    if is_text(code):
        return value
    kind = PARAMETER_TYPES.get(code, RANGES if code.endswith("_params") else None)
    if kind is None:
        return value
    literal = literal_json(value)
    if kind.startswith(("array", "map")):
        return F.from_json(literal, kind, {"mode": "FAILFAST"})
    return F.nullif(F.trim(literal, F.lit('"')), F.lit("null")).cast(kind)


def parse_config(wide: DataFrame) -> DataFrame:
    """Every parameter column of a pivoted configuration in its own type."""
    keys = {"timestamp", "stage"}
    return wide.select([c if c in keys else parse_parameter(F.col(c), c).alias(c) for c in wide.columns])


#: A text in single or double quotes.
QUOTED = r"([\"'])(.*?)\1"


def parameters_of_models(config: DataFrame) -> DataFrame:
    """(timestamp, stage, model_name, parameter_value) of each configured model.

    A parameter belongs to a model when its code contains the model's name.
    """
    names = config.where(F.col("parameter_code") == "model_names").select(
        "timestamp", "stage", F.explode(F.regexp_extract_all("parameter_value", F.lit(QUOTED), F.lit(2))).alias("model_name")
    )
    # Both sides share the equi-key (timestamp, stage): some tens of rows per run.
    return (
        config.join(names, ["timestamp", "stage"])
        .where(F.col("parameter_code").contains(F.col("model_name")))
        .select("timestamp", "stage", "model_name", "parameter_code", "parameter_value")
    )

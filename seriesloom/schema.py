"""Declared schemas of the stored tables and their keys."""

from pyspark.sql import types as T

_S, _D, _I, _N = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampNTZType()


def _table(**fields):
    """Columns in order, each a type or a (type, nullable) pair."""
    return T.StructType(
        [
            T.StructField(name, *(kind if isinstance(kind, tuple) else (kind, True)))
            for name, kind in fields.items()
        ]
    )


LOCATION = ["latitude", "longitude"]
SERIES = [*LOCATION, "variable_code"]

FEATURES = _table(
    timestamp=(_N, False),
    latitude=(_D, False),
    longitude=(_D, False),
    variable_code=(_S, False),
    value=_D,
    update_date=_N,
)
FEATURES_KEY = ["timestamp", *SERIES]

PREDICTIONS = _table(
    timestamp=(_N, False),
    model_date=(_N, False),
    model_name=(_S, False),
    model_type=(_S, False),
    model_version=(_I, False),
    latitude=(_D, False),
    longitude=(_D, False),
    target_variable=(_S, False),
    real_value=_D,
    predictions=_D,
    data_quality_percentage=_D,
    validation_boolean=_I,
    suggested_value=_D,
    update_date=_N,
)
PREDICTIONS_KEY = ["timestamp", *LOCATION, "target_variable"]
PREDICTION_MEASURES = [
    "real_value",
    "predictions",
    "data_quality_percentage",
    "validation_boolean",
    "suggested_value",
]

SCALER = T.ArrayType(
    T.StructType([T.StructField("name", _S), T.StructField("mean", _D), T.StructField("std", _D)])
)
REGISTRY = _table(
    model_date=(_N, False),
    model_name=(_S, False),
    model_type=(_S, False),
    latitude=(_D, False),
    longitude=(_D, False),
    target_variable=(_S, False),
    model_feature_names=T.ArrayType(_S),
    model_features_count=_I,
    model_version=_I,
    model_parameters=_S,
    model_metric_name=_S,
    model_metric_validation_value=_D,
    model_metric_test_value=_D,
    model_forecast_accuracy=_D,
    scaler=SCALER,
    model_path=_S,
    coefficients=T.ArrayType(_D),
    intercept=_D,
    lower_limit=_D,
    upper_limit=_D,
    feature_importances=T.MapType(_S, _D),
)
REGISTRY_KEY = ["model_date", "model_name", "model_type", *LOCATION, "target_variable"]

RUN_CONFIG = _table(
    timestamp=(_N, False),
    stage=(_S, False),
    parameter_code=(_S, False),
    parameter_value=_S,
    created_date=_N,
    update_date=_N,
)
RUN_CONFIG_KEY = ["timestamp", "stage", "parameter_code"]

HIGH_WATER = _table(
    latitude=(_D, False), longitude=(_D, False), data_type=(_S, False), timestamp=_N, update_date=_N
)
HIGH_WATER_KEY = [*LOCATION, "data_type"]

# The source variables, in the order they are requested.
SOURCE_VARIABLES = [
    "temperature_2m",
    "relative_humidity_2m",
    "precipitation",
    "pressure_msl",
    "surface_pressure",
    "cloud_cover",
    "wind_speed_10m",
    "sunshine_duration",
    "direct_radiation",
]


def raw_hourly(variables=SOURCE_VARIABLES) -> T.StructType:
    """Schema of one landed response: a start, an end, a step and one array per variable."""
    return T.StructType(
        [
            T.StructField("latitude", _D, False),
            T.StructField("longitude", _D, False),
            T.StructField("start_epoch", T.LongType(), False),
            T.StructField("end_epoch", T.LongType(), False),
            T.StructField("interval_s", _I, False),
            *[T.StructField(v, T.ArrayType(_D)) for v in variables],
        ]
    )

"""The same results as DuckDB SQL over the given tables."""

from __future__ import annotations

from checks.domain import NOW, PRIORITIES, RANGE, TIE_SHIFT, UPDATED, VARIABLES
from seriesloom.functions.params import SEED_CONFIG

SERIES = "latitude, longitude, variable_code"
TARGET = "latitude, longitude, target_variable"


def place(site: str) -> str:
    return (
        f"CAST(4100 + {site} AS DOUBLE) / CAST(100 AS DOUBLE) AS latitude, "
        f"CAST(200 + {site} AS DOUBLE) / CAST(100 AS DOUBLE) AS longitude"
    )


OBS = f"""obs AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, {place('user_id // 10')}, event_type AS variable_code,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (CAST(100 AS DOUBLE) * count(*)) AS value
  FROM events GROUP BY ALL)"""
GRID = (
    OBS
    + """, span AS (
  SELECT latitude, longitude, min(timestamp) AS min_date, max(timestamp) AS max_date FROM obs GROUP BY ALL),
axis AS (
  SELECT s.latitude, s.longitude, s.variable_code,
         unnest(generate_series(min_date, max_date, INTERVAL 1 HOUR))::TIMESTAMP AS timestamp
  FROM (SELECT DISTINCT latitude, longitude, variable_code FROM obs) s JOIN span USING (latitude, longitude)),
grid AS (SELECT a.*, o.value FROM axis a LEFT JOIN obs o USING (latitude, longitude, variable_code, timestamp))"""
)


def near(source: str, column: str = "value", keys: str = SERIES, order: str = "timestamp", name: str = "near") -> str:
    """Each row with the nearest value before and after it, itself included."""
    w = f"PARTITION BY {keys} ORDER BY {order}"
    past = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    future = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    held = f"CASE WHEN {column} IS NOT NULL THEN {order} END"
    return f"""{name} AS (SELECT *,
    last_value({column} IGNORE NULLS) OVER ({w} {past}) AS pv, last_value({held} IGNORE NULLS) OVER ({w} {past}) AS px,
    first_value({column} IGNORE NULLS) OVER ({w} {future}) AS nv, first_value({held} IGNORE NULLS) OVER ({w} {future}) AS nx
    FROM {source})"""


def line(column: str = "value", axis: str = "epoch_us({})", order: str = "timestamp") -> str:
    x, a, b = axis.format(order), axis.format("px"), axis.format("nx")
    return f"""CASE WHEN {column} IS NOT NULL THEN {column} WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
    ELSE pv + (nv - pv) * CAST({x} - {a} AS DOUBLE) / CAST({b} - {a} AS DOUBLE) END"""


FILLED = (
    GRID
    + ", "
    + near("grid")
    + f""", filled AS (
  SELECT {SERIES}, timestamp, coalesce({line()}, nv, 0.0) AS value FROM near)"""
)


def panel(*lags: int, name: str = "panel") -> str:
    columns = ", ".join(f"lag(value, {k}) OVER w AS lag_{k}" for k in lags)
    complete = " AND ".join(f"lag_{k} IS NOT NULL" for k in lags)
    return (
        FILLED
        + f""", {name} AS (SELECT * FROM (
  SELECT latitude, longitude, variable_code AS target_variable, timestamp, value, {columns},
         CAST(hour(timestamp) AS DOUBLE) AS hour
  FROM filled WINDOW w AS (PARTITION BY {SERIES} ORDER BY timestamp)) WHERE {complete})"""
    )


PREDS = (
    panel(24)
    + f""", preds AS (
  SELECT {TARGET}, timestamp, value AS real_value, lag_24 AS predictions,
         TIMESTAMP '2024-01-31 00:00:00' AS model_date, 'seasonal_naive' AS model_name,
         'autoval_reg' AS model_type, CAST(1 AS INTEGER) AS model_version
  FROM panel)"""
)
REGISTRY = f"""registry AS (
  SELECT o_orderdate + to_microseconds(o_orderkey) AS model_date,
         CASE WHEN o_orderkey % 2 = 0 THEN 'linear_regression' ELSE 'xgboost_regression' END AS model_name,
         'autoval_reg' AS model_type, {place('o_custkey // 10')}, o_orderpriority AS target_variable,
         CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS model_version,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 101 AS DOUBLE) AS model_forecast_accuracy,
         o_totalprice AS model_metric_test_value, o_orderkey AS model_path
  FROM orders)"""
SEEDS = ", ".join(f"({i}, '{stage}', '{code}', '{value}')" for i, (stage, code, value) in enumerate(SEED_CONFIG))
CONFIG = f"""config AS (
  SELECT timestamp, stage, parameter_code, parameter_value, timestamp + to_minutes(i) AS created_date,
         timestamp + to_minutes(i) AS update_date
  FROM (SELECT DISTINCT o_orderdate + to_hours(o_custkey % 24) AS timestamp FROM orders),
       (VALUES {SEEDS}) seeds(i, stage, parameter_code, parameter_value))"""
MARKS = (
    OBS
    + f""", marks AS (
  SELECT latitude, longitude, 'engineered_data' AS data_type, max(timestamp) AS timestamp,
         TIMESTAMP '{UPDATED}' AS update_date
  FROM obs WHERE timestamp < TIMESTAMP '2024-01-20 00:00:00' GROUP BY latitude, longitude)"""
)
SEASON = """CASE WHEN month({0}) * 100 + day({0}) BETWEEN 321 AND 620 THEN 1
  WHEN month({0}) * 100 + day({0}) BETWEEN 621 AND 922 THEN 2
  WHEN month({0}) * 100 + day({0}) BETWEEN 923 AND 1220 THEN 3 ELSE 0 END"""
WEEKDAY = "(isodow({0}) - 1)"
ACCURACY = """CASE WHEN {0} IS NULL OR {1} IS NULL THEN NULL WHEN {0} = 0 THEN CASE WHEN {1} <> 0 THEN 0.0 END
  ELSE greatest(0.0, least(100.0, (1 - abs({1} - {0}) / {2}) * 100)) END"""


def r(expression: str, digits: int = 6) -> str:
    return f"round(({expression}) + CAST({TIE_SHIFT * 10.0**-digits!r} AS DOUBLE), {digits}) + 0.0"


def calendar_rows(source: str) -> str:
    parts = {
        "hour": "hour(timestamp)",
        "month": "month(timestamp)",
        "weekday": WEEKDAY.format("timestamp"),
        "year_season": SEASON.format("timestamp"),
    }
    return " UNION ALL ".join(
        f"SELECT timestamp, latitude, longitude, '{k}' AS variable_code, CAST({v} AS DOUBLE) AS value, "
        f"TIMESTAMP '{UPDATED}' AS update_date FROM {source}"
        for k, v in parts.items()
    )


def pivoted(variables, source: str = "obs", keys: str = "latitude, longitude, timestamp") -> str:
    cells = ", ".join(f"max(CASE WHEN variable_code = '{v}' THEN value END) AS {v}" for v in variables)
    names = ", ".join(f"'{v}'" for v in variables)
    return f"SELECT {keys}, {cells} FROM {source} WHERE variable_code IN ({names}) GROUP BY {keys}"


O: dict[str, str] = {}

# ---------------------------------------------------------------- jobs

O["preprocess_features"] = f"""WITH {GRID}, {near('grid')}
SELECT timestamp, {SERIES}, {line()} AS value, TIMESTAMP '{UPDATED}' AS update_date FROM near
UNION ALL {calendar_rows('(SELECT DISTINCT latitude, longitude, timestamp FROM axis)')}"""

WEEK = GRID.replace("FROM events GROUP BY ALL", "FROM events WHERE date_trunc('hour', ts) BETWEEN "
    "TIMESTAMP '2024-01-23 23:00:00' AND TIMESTAMP '2024-01-30 23:00:00' GROUP BY ALL")  # fmt: skip
OWN = WEEK.replace(
    "SELECT latitude, longitude, min(timestamp) AS min_date, max(timestamp) AS max_date FROM obs GROUP BY ALL",
    "SELECT latitude, longitude, variable_code, min(timestamp) AS min_date, max(timestamp) AS max_date FROM obs GROUP BY ALL",
).replace("JOIN span USING (latitude, longitude)", "JOIN span USING (latitude, longitude, variable_code)")
O["rolling_week_rerun"] = f"""WITH {OWN}, {near('grid')}, lspan AS (
  SELECT latitude, longitude, min(timestamp) AS a, max(timestamp) AS z FROM obs GROUP BY ALL),
laxis AS (SELECT latitude, longitude, unnest(generate_series(a, z, INTERVAL 1 HOUR))::TIMESTAMP AS timestamp FROM lspan)
SELECT timestamp, {SERIES}, {line()} AS value, TIMESTAMP '{UPDATED}' AS update_date FROM near
UNION ALL {calendar_rows('laxis')}"""

FULL = GRID.replace(
    "SELECT latitude, longitude, min(timestamp) AS min_date, max(timestamp) AS max_date FROM obs GROUP BY ALL",
    "SELECT latitude, longitude, variable_code, min(timestamp) AS min_date, max(timestamp) AS max_date FROM obs GROUP BY ALL",
).replace("JOIN span USING (latitude, longitude)", "JOIN span USING (latitude, longitude, variable_code)")
O["preprocess_incremental"] = f"""WITH {FULL}, {near('grid')}, lspan AS (
  SELECT latitude, longitude, min(timestamp) AS a, max(timestamp) AS z FROM obs GROUP BY ALL),
laxis AS (SELECT latitude, longitude, unnest(generate_series(a, z, INTERVAL 1 HOUR))::TIMESTAMP AS timestamp FROM lspan)
SELECT timestamp, {SERIES}, {line()} AS value, TIMESTAMP '{UPDATED}' AS update_date FROM near
UNION ALL {calendar_rows('laxis')}"""

# ---------------------------------------------------------------- sources

# The arrays hold the hours of a day in order; hours are complete, so a value's index is its step.
SHORT = "(CAST(round(latitude * 100) AS INTEGER) % 3 = 0 AND step >= 5)"
ARRAYS = f"""hours AS (SELECT *, row_number() OVER (PARTITION BY latitude, longitude, date_trunc('day', timestamp)
  ORDER BY timestamp) - 1 AS step FROM ({pivoted(VARIABLES, 'filled')}))"""
# A day in the middle of the range always has all its hours for every variable of a site.
O["expand_hourly_arrays"] = f"""WITH {FILLED}, {ARRAYS}
SELECT latitude, longitude, timestamp, {', '.join(v for v in VARIABLES if v != 'view')},
  CASE WHEN {SHORT} THEN NULL ELSE view END AS view FROM hours"""
O["preprocess_landed"] = f"""WITH {FILLED}, wide AS ({pivoted(VARIABLES, 'filled')})
SELECT timestamp, {SERIES}, value, TIMESTAMP '{UPDATED}' AS update_date FROM (
  SELECT timestamp, latitude, longitude, unnest({VARIABLES}) AS variable_code, unnest([{', '.join(VARIABLES)}]) AS value FROM wide)
UNION ALL {calendar_rows('wide')}"""
O["feature_scan"] = f"""WITH {OBS} SELECT * FROM obs WHERE latitude = 41.01::DOUBLE AND longitude = 2.01::DOUBLE
  AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"""
O["feature_scan_regex"] = f"WITH {OBS} SELECT * FROM obs WHERE regexp_matches(variable_code, 'ick|sign')"
O["feature_scan_locations"] = f"""WITH {OBS} SELECT * FROM obs WHERE (latitude, longitude) IN (
  SELECT (latitude, longitude) FROM (SELECT {place('c_custkey // 10')} FROM customer WHERE c_acctbal > 5000))
  AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'"""
O["predictions_latest"] = f"""WITH {PREDS}, p AS (SELECT * FROM preds WHERE target_variable IN ('click', 'view'))
SELECT * FROM p WHERE timestamp = (SELECT max(timestamp) FROM p q WHERE q.latitude = p.latitude AND q.longitude = p.longitude)"""
O["predictions_range"] = f"""WITH {PREDS} SELECT * FROM preds
  WHERE timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 05:00:00'"""
O["config_scan"] = f"""WITH {CONFIG} SELECT * FROM config
  WHERE timestamp = TIMESTAMP '1995-01-04 21:00:00' AND stage = 'training'"""
O["registry_scan"] = f"""WITH {REGISTRY} SELECT model_date, latitude, longitude, target_variable, model_version FROM registry
  WHERE model_name = 'linear_regression' AND model_type = 'autoval_reg' AND regexp_matches(target_variable, 'URG|LOW')"""
O["registry_scan_date"] = f"""WITH {REGISTRY} SELECT model_date, latitude, longitude, target_variable, model_version FROM registry
  WHERE model_name = 'linear_regression' AND regexp_matches(target_variable, 'HIGH')
    AND model_date BETWEEN TIMESTAMP '1999-01-15 23:59:59.5' AND TIMESTAMP '1999-01-16 00:00:01.5'"""
O["registry_importances"] = f"""WITH {REGISTRY} SELECT model_date, model_name, model_type, {TARGET}, model_version,
  unnest(['a', 'b']) AS feature, unnest([model_forecast_accuracy, model_metric_test_value]) AS importance FROM registry"""
O["last_processed"] = f"""WITH {MARKS} SELECT latitude, longitude, m.timestamp FROM
  (SELECT DISTINCT latitude, longitude FROM obs) LEFT JOIN marks m USING (latitude, longitude)"""
O["distinct_coordinates"] = f"WITH {OBS} SELECT DISTINCT latitude, longitude FROM obs"
O["distinct_variables"] = "SELECT DISTINCT event_type AS variable_code FROM events"
O["target_variable"] = "SELECT min(event_type) AS target_variable FROM events WHERE event_type LIKE '%r%'"
O["partner_coordinate"] = f"""WITH {OBS} SELECT latitude, min(longitude) AS longitude FROM obs
  WHERE latitude = 41.01::DOUBLE GROUP BY latitude"""
O["date_bounds"] = f"""WITH {OBS} SELECT latitude, longitude, min(timestamp) AS min_date, max(timestamp) AS max_date
  FROM obs GROUP BY ALL"""
O["models_of_config"] = f"""WITH {CONFIG} SELECT *, stage || '_' || year(timestamp) AS model_id FROM config
  WHERE timestamp = TIMESTAMP '1995-01-04 21:00:00' AND stage = 'prediction'"""

# ---------------------------------------------------------------- sinks

BATCH = f"""{OBS}, batch AS (
  SELECT * REPLACE (value + 1 AS value) FROM obs WHERE timestamp >= TIMESTAMP '2024-01-20' UNION ALL
  SELECT * REPLACE (timestamp + INTERVAL 5 DAY AS timestamp, 0.5::DOUBLE AS value) FROM obs
  WHERE timestamp >= TIMESTAMP '2024-01-26')"""
UPSERT = f"""WITH {BATCH}
SELECT *, TIMESTAMP '{UPDATED}' AS update_date FROM obs o WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE
  o.timestamp = b.timestamp AND o.latitude = b.latitude AND o.longitude = b.longitude AND o.variable_code = b.variable_code)
UNION ALL SELECT *, TIMESTAMP '2024-02-02' FROM batch"""
O["upsert_features"] = UPSERT
O["upsert_features_table"] = UPSERT
O["upsert_predictions"] = f"""WITH {PREDS} SELECT * REPLACE (
  CASE WHEN hour(timestamp) = 12 THEN 1.5 ELSE predictions END AS predictions,
  CAST(CASE WHEN hour(timestamp) = 12 THEN 2 ELSE 1 END AS INTEGER) AS model_version),
  CASE WHEN hour(timestamp) = 12 THEN TIMESTAMP '2024-02-02' ELSE TIMESTAMP '{UPDATED}' END AS update_date FROM preds"""
O["upsert_registry"] = f"""WITH {REGISTRY}
SELECT * REPLACE (CASE WHEN model_name = 'linear_regression' THEN 50.0 ELSE model_forecast_accuracy END AS model_forecast_accuracy)
FROM registry UNION ALL
SELECT * REPLACE ('autoval_clf' AS model_type, 50.0 AS model_forecast_accuracy) FROM registry WHERE model_name = 'linear_regression'"""
O["upsert_config_partial"] = f"""WITH {CONFIG}
SELECT * REPLACE (
  CASE WHEN parameter_code IN ('n_iter', 'direction') THEN '9' ELSE parameter_value END AS parameter_value,
  CASE WHEN parameter_code IN ('n_iter', 'direction') THEN TIMESTAMP '{UPDATED}' ELSE update_date END AS update_date) FROM config
UNION ALL SELECT timestamp, stage, 'n_iter_extra', '9', TIMESTAMP '{UPDATED}', TIMESTAMP '{UPDATED}' FROM config
  WHERE parameter_code = 'n_iter'"""
O["delete_config"] = f"WITH {CONFIG} SELECT * FROM config WHERE timestamp <> TIMESTAMP '1995-01-04 21:00:00'"
O["delete_stored"] = f"""WITH {CONFIG} SELECT * FROM config
  WHERE stage <> 'prediction' AND timestamp <> TIMESTAMP '1995-01-04 21:00:00'"""
O["high_water_mark"] = f"""WITH {OBS} SELECT latitude, longitude, 'engineered_data' AS data_type,
  max(timestamp) AS timestamp, TIMESTAMP '2024-02-03' AS update_date FROM obs GROUP BY latitude, longitude"""
O["incremental_since_mark"] = f"""WITH {MARKS} SELECT o.* FROM obs o LEFT JOIN marks m USING (latitude, longitude)
  WHERE m.timestamp IS NULL OR o.timestamp > m.timestamp"""
O["save_features"] = f"""WITH {OBS} SELECT latitude, longitude, 'engineered_data' AS data_type,
  max(timestamp) AS timestamp, TIMESTAMP '{UPDATED}' AS update_date FROM obs GROUP BY latitude, longitude"""
O["publish_predictions"] = f"WITH {PREDS} SELECT {TARGET}, timestamp, predictions FROM preds"
O["nan_to_null"] = f"WITH {OBS} SELECT * REPLACE (CASE WHEN value > 100 THEN NULL ELSE value END AS value) FROM obs"

# ---------------------------------------------------------------- reshaping

O["pivot_wide"] = f"WITH {OBS} {pivoted(VARIABLES)}"
O["unpivot_long"] = f"""WITH {OBS}, wide AS ({pivoted(VARIABLES)}) SELECT latitude, longitude, timestamp,
  unnest({VARIABLES}) AS variable_code, unnest([{', '.join(VARIABLES)}]) AS value FROM wide"""
O["align_outer"] = f"WITH {OBS} {pivoted(VARIABLES)}"
O["pivot_predictions"] = (
    f"WITH {PREDS} SELECT latitude, longitude, timestamp, "
    + ", ".join(
        f"max(CASE WHEN target_variable = '{v}' THEN {m} END) AS {name}_{v}"
        for m, name in (
            ("real_value", "real_value"),
            ("predictions", "predictions"),
            ("predictions - real_value", "data_quality_percentage"),
            ("CAST(CAST(predictions > real_value AS INTEGER) AS DOUBLE)", "validation_boolean"),
            ("greatest(real_value, predictions)", "suggested_value"),
        )
        for v in VARIABLES
    )
    + " FROM preds GROUP BY latitude, longitude, timestamp"
)


def config_cells(codes) -> str:
    return ", ".join(f"max(CASE WHEN parameter_code = '{c}' THEN parameter_value END) AS {c}" for c in codes)


O["config_pivot"] = f"""WITH {CONFIG} SELECT timestamp, stage,
  {config_cells(['n_iter', 'cv_splits', 'direction', 'batch_size'])} FROM config GROUP BY timestamp, stage"""
O["parse_config"] = rf"""WITH {CONFIG}, w AS (SELECT timestamp, stage,
  {config_cells(['n_iter', 'test_size', 'direction', 'auto_training', 'model_names', 'xgboost_regression_params', 'mlpregressor_params'])}
  FROM config GROUP BY timestamp, stage)
SELECT timestamp, stage, CAST(n_iter AS INTEGER) AS n_iter, CAST(test_size AS DOUBLE) AS test_size, direction,
  CAST(CAST(auto_training AS BOOLEAN) AS INTEGER) AS auto_training,
  array_to_string(regexp_extract_all(model_names, '"([^"]+)"', 1), ',') AS model_names,
  '[' || regexp_extract(mlpregressor_params, '\(([0-9]+),\)\]', 1) || ']' AS layers_high,
  CAST(json_extract(xgboost_regression_params, '$.xgbregressor__max_depth[1]') AS DOUBLE) AS max_depth_high,
  CAST(json_extract(xgboost_regression_params, '$.xgbregressor__subsample[0]') AS DOUBLE) AS subsample_low FROM w"""
O["model_parameters"] = f"""WITH {CONFIG}, names AS (SELECT timestamp, stage,
  unnest(regexp_extract_all(parameter_value, '"([^"]+)"', 1)) AS model_name FROM config WHERE parameter_code = 'model_names')
SELECT timestamp, stage, model_name, parameter_code, parameter_value FROM config JOIN names USING (timestamp, stage)
  WHERE contains(parameter_code, model_name)"""
O["series_points"] = f"""WITH {OBS} SELECT {SERIES}, min(timestamp) AS page_start, count(*) AS n_points,
  max(timestamp) AS last_time, arg_max(value, timestamp) AS last_value
FROM (SELECT *, (row_number() OVER (PARTITION BY {SERIES} ORDER BY timestamp) - 1) // 100 AS page FROM obs
  WHERE variable_code IN ('click', 'view')) GROUP BY {SERIES}, page"""

# ---------------------------------------------------------------- gaps

O["interpolate_time"] = f"WITH {GRID}, {near('grid')} SELECT {SERIES}, timestamp, {line()} AS value FROM near"
O["interpolate_linear"] = f"""WITH {GRID}, g AS (SELECT * REPLACE (CASE WHEN hour(timestamp) >= 12
    THEN timestamp + INTERVAL 1 HOUR ELSE timestamp END AS timestamp),
  row_number() OVER (PARTITION BY {SERIES} ORDER BY timestamp) AS pos FROM grid), {near('g', order='pos')}
SELECT {SERIES}, timestamp, {line(axis='{}', order='pos')} AS value FROM near"""
O["forward_fill"] = f"WITH {GRID}, {near('grid')} SELECT {SERIES}, timestamp, pv AS value FROM near"
O["backward_fill"] = f"WITH {GRID}, {near('grid')} SELECT {SERIES}, timestamp, nv AS value FROM near"
O["fill_chain"] = f"WITH {FILLED} SELECT {SERIES}, timestamp, value FROM filled"
_wide, _parts = f"{OBS}, wide AS ({pivoted(VARIABLES)})", []
for _v in VARIABLES:
    _parts.append(near("wide", _v, "latitude, longitude", name=f"near_{_v}"))
    _parts.append(
        f"f_{_v} AS (SELECT latitude, longitude, timestamp, coalesce({line(_v)}, nv, 0.0) AS {_v} FROM near_{_v})"
    )
_join = " ".join(f"JOIN f_{v} USING (latitude, longitude, timestamp)" for v in VARIABLES[1:])
O["fill_chain_panel"] = (
    f"WITH {_wide}, {', '.join(_parts)} SELECT latitude, longitude, timestamp, {', '.join(VARIABLES)} "
    f"FROM f_{VARIABLES[0]} {_join}"
)
O["null_counts"] = (
    f"WITH {OBS}, wide AS ({pivoted(VARIABLES)}) SELECT "
    + ", ".join(f"count(*) - count({c}) AS {c}" for c in ["latitude", "longitude", "timestamp", *VARIABLES])
    + " FROM wide"
)
O["drop_incomplete"] = f"""WITH {OBS}, wide AS ({pivoted(VARIABLES)})
SELECT * FROM wide WHERE {' AND '.join(v + ' IS NOT NULL' for v in VARIABLES)}"""

# ---------------------------------------------------------------- ordered operators

O["smooth_predictions"] = f"""WITH {PREDS}, m AS (
  SELECT {TARGET}, timestamp, CASE WHEN count(predictions) OVER w = 100
    THEN avg(CASE WHEN predictions IS NOT NULL THEN greatest(0.0, predictions) END) OVER w END AS mean
  FROM (SELECT * REPLACE (CASE hour(timestamp) + 24 * day(timestamp) WHEN 100 THEN CAST('nan' AS DOUBLE) WHEN 300 THEN 1e17
    ELSE predictions END AS predictions) FROM preds)
  WINDOW w AS (PARTITION BY {TARGET} ORDER BY timestamp ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
{near('m', 'mean', TARGET, name='near2')}
SELECT {TARGET}, timestamp, {r('coalesce(nv, pv)')} AS predictions FROM near2"""
O["lag_features"] = f"""WITH {FILLED}, l AS (SELECT {SERIES}, timestamp, value,
  lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 24) OVER w AS c
  FROM filled WINDOW w AS (PARTITION BY {SERIES} ORDER BY timestamp))
SELECT {SERIES}, timestamp, value, round_even(a, 2) AS lag_1, round_even(b, 2) AS lag_2, round_even(c, 2) AS lag_24
FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"""


def acf(nlags: int, source: str) -> str:
    return f"""x AS (SELECT {SERIES}, value - avg(value) OVER (PARTITION BY {SERIES}) AS x,
    row_number() OVER (PARTITION BY {SERIES} ORDER BY timestamp) AS i, count(*) OVER (PARTITION BY {SERIES}) AS n FROM {source}),
  gamma AS (SELECT {', '.join('a.' + k for k in SERIES.split(', '))}, max(a.n) AS n, k AS lag, sum(a.x * b.x) / (max(a.n) - max(k)) AS g
    FROM x a CROSS JOIN range({nlags + 1}) t(k) JOIN x b ON a.latitude = b.latitude AND a.longitude = b.longitude
     AND a.variable_code = b.variable_code AND b.i = a.i - k GROUP BY ALL)"""


def pacf(nlags: int, source: str) -> str:
    """Durbin-Levinson as a recursion over the lag; the coefficients so far are a list."""
    return (
        acf(nlags, source)
        + f""", g AS (SELECT {SERIES}, max(n) AS n, list(g ORDER BY lag) AS g,
     greatest(0, least({nlags}, max(n) // 2 - 1)) AS m FROM gamma GROUP BY {SERIES}),
  d AS (SELECT {SERIES}, g, m, 0 AS k, CAST([] AS DOUBLE[]) AS phi, g[1] AS e, CAST(1 AS DOUBLE) AS pacf FROM g
    UNION ALL
    SELECT {SERIES}, g, m, k + 1,
      list_append(list_transform(range(1, k + 1), lambda j: phi[j] - l * phi[k + 1 - j]), l), e * (1 - l * l), l
    FROM (SELECT *, (g[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * g[k + 2 - j])), 0)) / e AS l
          FROM d WHERE k < m))"""
    )


O["acf"] = f"""WITH {FILLED}, {acf(50, 'filled')}
SELECT {SERIES}, n, CAST(lag AS INTEGER) AS lag, {r('g')} AS autocovariance FROM gamma"""
O["select_lags"] = f"""WITH RECURSIVE {FILLED}, {pacf(50, 'filled')}
SELECT {SERIES}, CAST(k AS INTEGER) AS lag, {r('pacf')} AS pacf,
  CAST(CASE WHEN k > 0 AND abs(pacf) >= 0.2 THEN 1 ELSE 0 END AS INTEGER) AS kept FROM d"""
O["supervised_lags"] = f"""WITH RECURSIVE {GRID}, g0 AS (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY timestamp) AS pos FROM grid),
{near('g0', order='pos')}, f AS (SELECT {SERIES}, timestamp, pos, coalesce({line(axis='{}', order='pos')}, nv) AS value FROM near),
{pacf(50, 'f')},
chosen AS (SELECT {SERIES}, list(k ORDER BY k) FILTER (k > 0 AND abs(pacf) >= 0.2) AS lags FROM d GROUP BY {SERIES}),
l AS (SELECT f.*, lags, lag(value, coalesce(lags[1], 1)) OVER (PARTITION BY {SERIES} ORDER BY pos) AS a
  FROM f JOIN chosen USING (latitude, longitude, variable_code))
SELECT {SERIES}, timestamp, CAST(coalesce(len(lags), 0) AS INTEGER) AS n_lags,
  CASE WHEN lags IS NOT NULL THEN round_even(a, 2) END AS lag_1 FROM l WHERE pos > coalesce(list_max(lags), 0)"""
O["train_test_split_time"] = f"""WITH {FILLED} SELECT {SERIES}, timestamp, value,
  CASE WHEN row_number() OVER (PARTITION BY {SERIES} ORDER BY timestamp)
    > count(*) OVER (PARTITION BY {SERIES}) - ceil(count(*) OVER (PARTITION BY {SERIES}) * 0.1::DOUBLE)
  THEN 'test' ELSE 'train' END AS split FROM filled"""


def blocks(splits: int, source: str, keys: str) -> str:
    return f"""p AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY timestamp) - 1 AS i,
    count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
  b AS (SELECT *, CASE WHEN n // {splits + 1} = 0 THEN 0
    ELSE greatest(0, CAST(floor((i - (n - {splits} * (n // {splits + 1}))) / CAST(n // {splits + 1} AS DOUBLE)) AS INTEGER) + 1) END
    AS block FROM p)"""


O["time_series_folds"] = f"""WITH {OBS}, {blocks(10, 'obs', SERIES)}
SELECT {SERIES}, CAST(fold AS INTEGER) AS fold, CASE WHEN block = fold + 1 THEN 'test' ELSE 'train' END AS role,
  count(*) AS n, min(timestamp) AS first, max(timestamp) AS last
FROM b, range(10) t(fold) WHERE block <= fold + 1 GROUP BY ALL"""

# ---------------------------------------------------------------- scalars

O["calendar_features"] = f"""SELECT event_id, ts AS timestamp, CAST(hour(ts) AS INTEGER) AS hour,
  CAST(month(ts) AS INTEGER) AS month, CAST({WEEKDAY.format('ts')} AS INTEGER) AS weekday,
  CAST({SEASON.format('ts')} AS INTEGER) AS year_season, CAST(day(ts) AS INTEGER) AS day_of_month FROM events"""
O["season"] = f"""SELECT o_orderdate, CAST({SEASON.format('o_orderdate')} AS INTEGER) AS season, count(*) AS n
  FROM orders GROUP BY o_orderdate"""
O["shift_date"] = """SELECT o_orderkey, date_trunc('day', t - INTERVAL 100 DAY)::TIMESTAMP AS days_back,
  date_trunc('day', t - INTERVAL 365 DAY)::TIMESTAMP AS quarters_back, date_trunc('day', t + INTERVAL 7 HOUR)::TIMESTAMP AS hours_on
FROM (SELECT o_orderkey, o_orderdate + to_hours(o_custkey % 24) AS t FROM orders)"""
O["resolve_preprocess_ranges"] = f"""WITH {MARKS} SELECT latitude, longitude,
  date_trunc('day', coalesce(m.timestamp, TIMESTAMP '{UPDATED}') - INTERVAL 100 DAY)::TIMESTAMP AS start_date,
  TIMESTAMP '{UPDATED}' AS end_date
FROM (SELECT DISTINCT latitude, longitude FROM obs) LEFT JOIN marks m USING (latitude, longitude)"""
O["resolve_training_ranges"] = f"""WITH {OBS} SELECT latitude, longitude, TIMESTAMP '2024-01-02' AS start_date,
  max(timestamp) AS end_date FROM obs GROUP BY latitude, longitude"""
O["resolve_prediction_ranges"] = f"""WITH {OBS}, f AS (SELECT latitude, longitude, max(timestamp) AS fm FROM obs GROUP BY ALL),
p AS (SELECT latitude, longitude, max(timestamp) AS pm FROM obs WHERE CAST(round(latitude * 100) AS INTEGER) % 2 = 0
  AND (hour(timestamp) < 21 OR CAST(round(latitude * 100) AS INTEGER) % 4 = 0) GROUP BY ALL),
w AS (SELECT latitude, longitude, fm, coalesce(pm, date_trunc('day', fm - INTERVAL 100 HOUR)) AS s
  FROM f LEFT JOIN p USING (latitude, longitude))
SELECT latitude, longitude, (CASE WHEN fm - s <= INTERVAL 3 HOUR THEN s - INTERVAL 4 HOUR ELSE s END)::TIMESTAMP AS start_date,
  fm AS end_date FROM w"""
ODD = "CASE WHEN p_size % 5 = 0 THEN 'None' WHEN p_size % 5 = 1 THEN '' ELSE p_brand END"
O["clean_names"] = f"""SELECT p_partkey, 'bcn/' || p_size || '/' || p_name AS without_valor,
  'valor_' || p_name AS without_location,
  CASE WHEN p_size % 5 > 1 THEN p_brand || '\\' ELSE '' END || p_size || '\\' || p_partkey || '\\' || p_type AS variable_key,
  p_size AS number, 'min' AS unit, regexp_replace(p_name, '\\W+', '_', 'g') AS safe_name,
  CASE WHEN {ODD} IN ('', 'None') THEN NULL ELSE {ODD} END AS normalised FROM part"""
O["clip_and_round"] = """SELECT CASE WHEN l_quantity > 2 THEN greatest(10.0, least(40.0, l_quantity)) END AS clipped,
  round_even(l_extendedprice / 1000, 1) AS thousands, count(*) AS n FROM lineitem GROUP BY ALL"""

# ---------------------------------------------------------------- metrics and validation

MEAN_ACCURACY = "greatest(0.0, least(100.0, avg((1 - abs({1} - {0}) / nullif({0}, 0)) * 100)))"
O["regression_metrics"] = f"""WITH m AS (SELECT l_returnflag, l_linestatus, l_extendedprice / 1000 AS y,
  l_quantity * 2 AS p FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n, {r('avg((y - p) * (y - p))', 4)} AS mean_squared_error,
  {r('sqrt(avg((y - p) * (y - p)))', 4)} AS root_mean_squared_error,
  {r('100 * sqrt(avg(((y - p) / (y + 1e-10)) * ((y - p) / (y + 1e-10))))', 4)} AS root_mean_squared_percentage_error,
  {r('avg(abs(y - p))', 4)} AS mean_absolute_error,
  {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 4)} AS r2,
  {r(MEAN_ACCURACY.format('y', 'p'), 4)} AS forecast_accuracy, count(*) FILTER (y = 0) AS zero_actuals
FROM m GROUP BY l_returnflag, l_linestatus"""
O["evaluate_predictions"] = f"""WITH {PREDS} SELECT {TARGET}, count(*) AS n,
  {r('avg(abs(real_value - predictions))')} AS mean_absolute_error,
  {r('sqrt(avg((real_value - predictions) * (real_value - predictions)))')} AS root_mean_squared_error,
  {r("CASE WHEN bool_or(real_value = 0 AND predictions <> 0) THEN 0.0 ELSE " + MEAN_ACCURACY.format('real_value', 'predictions') + " END")}
    AS forecast_accuracy, count(*) FILTER (real_value = 0) AS zero_actuals FROM preds GROUP BY {TARGET}"""
LABELLED = "labelled AS (SELECT l.*, d.lang, d.n_chars FROM labels l JOIN documents d USING (doc_id))"
O["confusion_matrix"] = f"""WITH {LABELLED} SELECT lang, quality AS actual, toxic AS predicted, count(*) AS n
  FROM labelled GROUP BY ALL"""
O["classification_metrics"] = f"""WITH {LABELLED}, c AS (SELECT lang, class,
    count(*) FILTER (quality = class AND toxic = class) AS tp, count(*) FILTER (quality <> class AND toxic = class) AS fp,
    count(*) FILTER (quality = class AND toxic <> class) AS fn
  FROM labelled, (SELECT unnest([0, 1]) AS class) GROUP BY lang, class),
f AS (SELECT *, tp + fn AS support, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c WHERE tp + fp + fn > 0)
SELECT lang, CAST(sum(support) AS BIGINT) AS n, {r('sum(tp) / sum(support)')} AS accuracy,
  {r('avg(tp / nullif(support, 0))')} AS balanced_accuracy, {r('avg(f1)')} AS f1_macro,
  {r('2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))')} AS f1_micro, {r('sum(f1 * support) / sum(support)')} AS f1_weighted,
  {r('coalesce(max(f1) FILTER (class = 1), 0)')} AS f1_binary FROM f GROUP BY lang"""
O["log_loss"] = f"""WITH {LABELLED}, p AS (SELECT lang, quality AS y,
  greatest(1e-15, least(1 - 1e-15, CAST(n_chars % 1001 AS DOUBLE) / 1000)) AS p FROM labelled)
SELECT lang, {r('-avg(y * ln(p) + (1 - y) * ln(1 - p))')} AS score FROM p GROUP BY lang"""
O["exact_quartiles"] = """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3,
  quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem GROUP BY ALL"""
O["exact_quantiles"] = f"""WITH q AS (SELECT o_orderpriority, count(*) AS n,
  quantile_cont(o_totalprice, [0.0, 0.1, 0.5, 0.99, 1.0]) AS qs FROM orders GROUP BY ALL),
u AS (SELECT o_orderpriority, n, unnest([0.0, 0.1, 0.5, 0.99, 1.0]::DOUBLE[]) AS probability, unnest(qs) AS quantile FROM q)
SELECT o_orderpriority, n, probability, {r('quantile')} AS quantile FROM u"""
QUARTILES = f"""quart AS (SELECT {TARGET}, quantile_cont(real_value - predictions, 0.25) AS q1,
  quantile_cont(real_value - predictions, 0.75) AS q3 FROM preds GROUP BY {TARGET}),
thr AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_threshold, q3 + 1.5 * (q3 - q1) AS upper_threshold FROM quart)"""
O["iqr_thresholds"] = f"""WITH {PREDS}, {QUARTILES} SELECT {TARGET}, {r('q1')} AS q1, {r('q3')} AS q3,
  {r('lower_threshold')} AS lower_threshold, {r('upper_threshold')} AS upper_threshold FROM thr"""
O["iqr_thresholds_limited"] = f"""WITH {PREDS}, {QUARTILES} SELECT {TARGET}, {r('q1')} AS q1, {r('q3')} AS q3,
  {r('greatest(lower_threshold, -40.0)')} AS lower_threshold,
  {r("CASE WHEN target_variable <> 'view' THEN least(upper_threshold, 35.0) ELSE upper_threshold END")} AS upper_threshold FROM thr"""
O["forecast_accuracy"] = f"""WITH {PREDS}, p AS (SELECT {TARGET}, timestamp, real_value - 10 AS y, predictions AS p FROM preds)
SELECT {TARGET}, timestamp, {ACCURACY.format('y', 'p', 'y')} AS signed, {ACCURACY.format('y', 'p', 'abs(y)')} AS absolute FROM p"""
CHECKED = f"""checked AS (SELECT preds.*, {ACCURACY.format('real_value', 'predictions', 'real_value')} AS data_quality_percentage,
  CAST(CASE WHEN real_value - predictions >= lower_threshold AND real_value - predictions <= upper_threshold THEN 1 ELSE 0 END AS INTEGER)
    AS validation_boolean FROM preds JOIN thr USING (latitude, longitude, target_variable)),
final AS (SELECT *, CASE WHEN validation_boolean = 1 AND data_quality_percentage >= 60 THEN real_value ELSE predictions END
  AS suggested_value FROM checked)"""
O["validate_predictions"] = f"""WITH {PREDS}, {QUARTILES}, {CHECKED} SELECT {TARGET}, timestamp,
  data_quality_percentage, validation_boolean, suggested_value FROM final"""
O["prediction_records"] = f"""WITH {PREDS}, {QUARTILES}, {CHECKED} SELECT *, TIMESTAMP '{UPDATED}' AS update_date FROM final"""
O["suggested_values"] = f"""WITH m AS (SELECT l_returnflag, l_extendedprice / 1000 AS y, l_quantity * 2 AS p FROM lineitem),
v AS (SELECT *, {ACCURACY.format('y', 'p', 'y')} AS acc, CAST(CASE WHEN y - p BETWEEN -20 AND 20 THEN 1 ELSE 0 END AS INTEGER) AS flag FROM m)
SELECT l_returnflag, flag, count(*) AS n, CAST(sum(CAST(round(
  CASE WHEN flag = 1 AND acc >= 50 THEN y ELSE p END * 1000) AS BIGINT)) AS BIGINT) AS suggested_thousandths FROM v GROUP BY ALL"""

# ---------------------------------------------------------------- registry

WANTED = f"""{REGISTRY}, wanted AS (SELECT 'autoval_reg' AS model_type, latitude, longitude,
  unnest({[*PRIORITIES, '6-NONE']}) AS target_variable FROM (SELECT DISTINCT {place('c_custkey // 10')} FROM customer))"""
KEY4 = f"model_type, {TARGET}"
O["next_model_version"] = f"""WITH {WANTED} SELECT {KEY4}, CAST(coalesce(max(model_version), 0) + 1 AS INTEGER) AS model_version
  FROM wanted LEFT JOIN registry USING ({KEY4}) GROUP BY {KEY4}"""
O["most_recent_model"] = f"""WITH {REGISTRY} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {KEY4}
  ORDER BY model_version DESC, model_date DESC) AS rn FROM registry) WHERE rn = 1"""


def best(days: int) -> str:
    return f"""{REGISTRY}, recent AS (SELECT * FROM registry r WHERE model_date BETWEEN
    (SELECT max(model_date) - INTERVAL {days} DAY FROM registry q WHERE q.target_variable = r.target_variable) AND
    (SELECT max(model_date) + INTERVAL {days} DAY FROM registry q WHERE q.target_variable = r.target_variable)),
  best AS (SELECT * FROM recent r WHERE model_forecast_accuracy =
    (SELECT max(model_forecast_accuracy) FROM recent q WHERE q.target_variable = r.target_variable))"""


O["best_model_in_window"] = f"WITH {best(1)} SELECT * FROM best"
O["best_model"] = f"""WITH {best(30)} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
  PARTITION BY target_variable ORDER BY model_version DESC, model_date DESC) AS rn FROM best) WHERE rn = 1"""
O["stale_targets"] = f"""WITH {WANTED}, last AS (SELECT {KEY4}, model_date AS last_trained FROM (SELECT *, row_number() OVER (
  PARTITION BY {KEY4} ORDER BY model_version DESC, model_date DESC) AS rn FROM registry) WHERE rn = 1)
SELECT {KEY4}, last_trained, CASE WHEN last_trained IS NULL THEN 'untrained' ELSE 'stale' END AS reason
FROM wanted LEFT JOIN last USING ({KEY4})
WHERE last_trained IS NULL OR last_trained <= TIMESTAMP '{NOW}' - INTERVAL 90 DAY"""
O["untrained_targets"] = f"WITH {WANTED} SELECT {KEY4} FROM wanted EXCEPT SELECT {KEY4} FROM registry"
O["models_matching_suffix"] = """SELECT o_orderkey AS model_path, o_orderpriority AS target_variable FROM orders
  WHERE regexp_matches(o_orderpriority, '(GENT)$')"""
O["early_stopping"] = """WITH t AS (SELECT o_custkey AS study, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS trial,
  o_totalprice AS score, o_orderstatus = 'P' AS pruned FROM orders),
s AS (SELECT *, CASE WHEN NOT pruned THEN score END AS s FROM t),
b AS (SELECT *, min(s) OVER (PARTITION BY study ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b0,
  min(s) OVER (PARTITION BY study ORDER BY trial) AS best FROM s),
u AS (SELECT *, max(CASE WHEN s IS NOT NULL AND (b0 IS NULL OR s < b0) THEN trial END) OVER (PARTITION BY study ORDER BY trial) AS up,
  max(CASE WHEN NOT pruned THEN trial END) OVER (PARTITION BY study ORDER BY trial) AS kept FROM b),
x AS (SELECT study, min(trial) FILTER (trial - up >= 3) AS no_improvement,
  min(trial) FILTER (trial - coalesce(kept, -1) >= 3) AS pruned_in_a_row,
  min(trial) FILTER (best < 20000) AS past_threshold FROM u GROUP BY study)
SELECT *, least(no_improvement, pruned_in_a_row, past_threshold) AS stop_trial FROM x"""

# ---------------------------------------------------------------- models

STATS = f"""st AS (SELECT {SERIES}, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS s
  FROM filled GROUP BY {SERIES})"""
O["scale_fit"] = f"WITH {FILLED}, {STATS} SELECT {SERIES}, 'value' AS name, {r('m')} AS mean, {r('s')} AS std FROM st"
O["scale_transform"] = f"""WITH {FILLED}, {STATS} SELECT {SERIES}, timestamp, {r('(value - m) / s')} AS value
  FROM filled JOIN st USING ({SERIES})"""
O["inverse_scale"] = f"""WITH {FILLED}, {STATS} SELECT {SERIES}, timestamp, {r('value')} AS value, {r('value + s')} AS prediction
  FROM filled JOIN st USING ({SERIES})"""
O["polynomial_features"] = """SELECT p_partkey, p_size AS a, p_retailprice AS b, CAST(1 AS DOUBLE) AS bias,
  CAST(p_size * p_size AS DOUBLE) AS aa, p_size * p_retailprice AS ab, p_retailprice * p_retailprice AS bb FROM part"""
O["align_features"] = f"""WITH {panel(1, 2, 24)} SELECT {TARGET}, timestamp, hour, lag_2, CAST(0 AS DOUBLE) AS lag_7 FROM panel"""
ONE = panel(1)
FIT = f"""fit AS (SELECT {TARGET}, count(*) AS n, coalesce(regr_slope(value, lag_1), 0) AS slope,
  coalesce(regr_intercept(value, lag_1), avg(value)) AS intercept FROM panel GROUP BY {TARGET})"""
O["linear_fit"] = f"WITH {ONE}, {FIT} SELECT {TARGET}, n, {r('slope')} AS slope, {r('intercept')} AS intercept FROM fit"


def cross_validation(source: str) -> str:
    return f"""{blocks(10, source, TARGET)},
  cv AS (SELECT {TARGET}, fold, coalesce(regr_slope(value, lag_1), 0) AS slope,
    coalesce(regr_intercept(value, lag_1), avg(value)) AS intercept
    FROM b, range(10) t(fold) WHERE block <= fold GROUP BY ALL),
  sc AS (SELECT {TARGET}, fold, sqrt(avg((value - intercept - slope * lag_1) * (value - intercept - slope * lag_1))) AS rmse,
    avg(abs(value - intercept - slope * lag_1)) AS mae
    FROM b JOIN cv USING ({TARGET}) WHERE b.block = cv.fold + 1 GROUP BY ALL)"""


CV = f"{ONE}, {cross_validation('panel')}"
O["linear_cv"] = f"WITH {CV} SELECT {TARGET}, CAST(fold AS INTEGER) AS fold, {r('rmse')} AS rmse, {r('mae')} AS mae FROM sc"
O["linear_fold_means"] = f"""WITH {CV} SELECT {TARGET}, 'lag_1' AS feature, {r('avg(slope)')} AS coefficient,
  {r('avg(rmse)')} AS validation_score FROM cv JOIN sc USING ({TARGET}, fold) GROUP BY {TARGET}"""
O["score_linear"] = f"""WITH {ONE}, {FIT} SELECT {TARGET}, timestamp, value, {r('intercept + slope * lag_1')} AS predictions
  FROM panel JOIN fit USING ({TARGET})"""
O["linear_importance"] = f"""WITH {ONE}, {FIT}, st AS (SELECT {TARGET}, avg(lag_1) AS mx, stddev_pop(lag_1) AS sx,
  stddev_pop(value) AS sy FROM panel GROUP BY {TARGET})
SELECT {TARGET}, 'lag_1' AS feature, {r('avg(abs(slope * (lag_1 - mx) / CASE WHEN sy = 0 THEN 1 ELSE sy END))')} AS importance
FROM panel JOIN fit USING ({TARGET}) JOIN st USING ({TARGET}) GROUP BY {TARGET}"""
O["evaluate_models"] = f"""WITH {ONE}, {FIT}, p AS (SELECT {TARGET}, value AS y, intercept + slope * lag_1 AS p
  FROM panel JOIN fit USING ({TARGET}))
SELECT {TARGET}, count(*) AS n, {r('sqrt(avg((y - p) * (y - p)))')} AS root_mean_squared_error,
  {r(MEAN_ACCURACY.format('y', 'p'))} AS forecast_accuracy, count(*) FILTER (y = 0) AS zero_actuals FROM p GROUP BY {TARGET}"""

TRAINED = f"""{ONE}, cut AS (SELECT *, row_number() OVER (PARTITION BY {TARGET} ORDER BY timestamp) >
    count(*) OVER (PARTITION BY {TARGET}) - ceil(count(*) OVER (PARTITION BY {TARGET}) * 0.1::DOUBLE) AS is_test FROM panel),
train AS (SELECT * EXCLUDE is_test FROM cut WHERE NOT is_test),
fit AS (SELECT {TARGET}, coalesce(regr_slope(value, lag_1), 0) AS slope, coalesce(regr_intercept(value, lag_1), avg(value)) AS intercept,
  CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sy FROM train GROUP BY {TARGET})"""
O["train_register_linear"] = f"""WITH {TRAINED}, {cross_validation('train')},
val AS (SELECT {TARGET}, avg(rmse) AS rmse FROM sc GROUP BY {TARGET}),
test AS (SELECT {TARGET}, value AS y, intercept + slope * lag_1 AS p FROM cut JOIN fit USING ({TARGET}) WHERE is_test)
SELECT {TARGET}, 'linear_regression' AS model_name, CAST(1 AS INTEGER) AS model_version, CAST(1 AS INTEGER) AS model_features_count,
  {r('max(rmse / sy)')} AS validation, {r('sqrt(avg((y - p) * (y - p)))')} AS test, {r(MEAN_ACCURACY.format('y', 'p'))} AS accuracy
FROM test JOIN val USING ({TARGET}) JOIN fit USING ({TARGET}) GROUP BY {TARGET}"""
O["predict_and_validate"] = f"""WITH {TRAINED}, preds AS (SELECT {TARGET}, timestamp, value AS real_value,
    intercept + slope * lag_1 AS predictions FROM panel JOIN fit USING ({TARGET})), {QUARTILES}, {CHECKED},
m AS (SELECT *, CASE WHEN count(predictions) OVER w = 100 THEN avg(greatest(0.0, predictions)) OVER w END AS mean
  FROM final WINDOW w AS (PARTITION BY {TARGET} ORDER BY timestamp ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
{near('m', 'mean', TARGET, name='near2')}
SELECT {TARGET}, timestamp, real_value, validation_boolean, {r('coalesce(nv, pv)')} AS predictions,
  {r('data_quality_percentage')} AS data_quality_percentage, {r('suggested_value')} AS suggested_value FROM near2"""

O["run_jobs"] = O["predict_and_validate"]
O["job_marks"] = f"""WITH {ONE}, t AS (SELECT DISTINCT {TARGET} FROM panel)
SELECT latitude, longitude, max(timestamp) AS timestamp,
  (SELECT count(*) FROM t WHERE t.latitude = panel.latitude AND t.longitude = panel.longitude) AS n_models,
  CAST(1 AS INTEGER) AS version FROM panel GROUP BY latitude, longitude"""

O["tune_search_facts"] = """SELECT CAST(3 AS BIGINT) AS n_trials, TRUE AS in_order, CAST(3 AS BIGINT) AS n_decided,
  CAST(3 AS INTEGER) AS n_params FROM (SELECT count(*) FROM events)"""
O["tune_classifier_facts"] = """SELECT CAST(3 AS BIGINT) AS n_trials, TRUE AS in_order, CAST(3 AS BIGINT) AS n_decided,
  CAST(2 AS INTEGER) AS n_params FROM (SELECT count(*) FROM labels)"""
O["gbt_panel_facts"] = f"""WITH {panel(1, 2, 24)} SELECT {TARGET}, CAST(ceil(count(*) * 0.1::DOUBLE) AS BIGINT) AS n, TRUE AS scored
  FROM panel GROUP BY {TARGET}"""



def tree_level(rows: str, cells: str, cuts: str, best: str, p: dict) -> str:
    """CTEs that find the best cut of every node: ``rows`` has the series, node, g, hour and weekday."""
    a, lam, most = p.get("reg_alpha", 0), p.get("reg_lambda", 1), p.get("max_delta_step", 0)

    def weight(g, n):
        w = f"(-sign({g}) * greatest(abs({g}) - {a}, 0.0::DOUBLE) / ({n} + {lam}))"
        return f"greatest(least({w}, {most}), -{most})" if most else w

    def score(g, n):
        return f"-(2 * {g} * {weight(g, n)} + ({n} + {lam}) * {weight(g, n)} ** 2 + 2 * {a} * abs({weight(g, n)}))"

    return f"""{cells} AS (SELECT {TARGET}, node, feature, v, sum(g) AS g, count(*) AS n FROM (
    SELECT {TARGET}, node, g, 0 AS feature, hour AS v FROM {rows} UNION ALL SELECT {TARGET}, node, g, 1, weekday FROM {rows}) GROUP BY ALL),
{cuts} AS (SELECT *, g - gl AS gr, n - nl AS nr FROM (SELECT {TARGET}, node, feature, v, sum(g) OVER (f ORDER BY v) AS gl, sum(n) OVER (f ORDER BY v) AS nl,
    sum(g) OVER f AS g, sum(n) OVER f AS n FROM {cells} WINDOW f AS (PARTITION BY {TARGET}, node, feature))),
{cuts}_gain AS (SELECT *, {score('gl', 'nl')} + {score('gr', 'nr')} - {score('g', 'n')} AS gain FROM {cuts}
    WHERE nr > 0 AND least(nl, nr) >= {p.get('min_child_weight', 1)}),
{best} AS (SELECT c.*, s.feature, s.v, s.gain, s.gl, s.nl, s.gr, s.nr FROM (SELECT {TARGET}, node, any_value(g) AS g, any_value(n) AS n FROM {cuts} WHERE feature = 0 GROUP BY ALL) c
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {TARGET}, node ORDER BY gain DESC, feature, v) AS o FROM {cuts}_gain
      WHERE gain > {p.get('min_split_loss', 0)}) WHERE o = 1) s USING ({TARGET}, node))"""


def first_tree(p: dict, ending: str = "") -> str:
    lam, a, most, rate = p.get("reg_lambda", 1), p.get("reg_alpha", 0), p.get("max_delta_step", 0), p.get("learning_rate", 0.3)
    w = f"(-sign(g) * greatest(abs(g) - {a}, 0.0::DOUBLE) / (n + {lam}))"
    w = f"greatest(least({w}, {most}), -{most})" if most else w
    row = "hour, weekday, g"
    steps = f"""rows0 AS (SELECT {TARGET}, 1 AS node, hour, CAST(isodow(timestamp) - 1 AS DOUBLE) AS weekday,
    avg(value) OVER (PARTITION BY {TARGET}) - value AS g FROM panel), {tree_level('rows0', 'cells0', 'cuts0', 'best0', p)}"""
    split, last = ["best0"], "best0"
    for level in range(1, p["max_depth"]):
        prev = level - 1
        steps += f""", rows{level} AS (SELECT {TARGET}, 2 * node + CAST(CASE WHEN feature = 0 THEN hour > v ELSE weekday > v END AS INTEGER) AS node, {row}
    FROM (SELECT r.{TARGET.replace(', ', ', r.')}, r.node, r.hour, r.weekday, r.g, b.feature, b.v FROM rows{prev} r JOIN best{prev} b USING ({TARGET}, node)
      WHERE b.feature IS NOT NULL)), {tree_level(f'rows{level}', f'cells{level}', f'cuts{level}', f'best{level}', p)}"""
        last = f"best{level}"
        split.append(last)
    nodes = " UNION ALL ".join(f"SELECT {TARGET}, node, feature, v, gain, g, n FROM {b}" for b in split)
    ends = " UNION ALL ".join(f"SELECT {TARGET}, 2 * node + {k}, NULL, NULL, NULL, g{side}, n{side} FROM {last} WHERE feature IS NOT NULL" for k, side in ((0, "l"), (1, "r")))
    if ending:
        return f"WITH {ONE}, {steps} {ending}"
    return f"""WITH {ONE}, {steps}, nodes AS ({nodes} UNION ALL {ends})
SELECT {TARGET}, CAST(node AS INTEGER) AS node, CAST(feature AS INTEGER) AS feature, v AS threshold, {r('gain')} AS gain,
  CASE WHEN feature IS NULL THEN {r(f'{rate} * {w}')} END AS value, CAST(n AS BIGINT) AS cover FROM nodes"""


O["boosted_stump"] = first_tree({"max_depth": 1})
O["boosted_depth2"] = first_tree(
    {"max_depth": 2, "reg_alpha": 3.0, "reg_lambda": 5.0, "max_delta_step": 4.0, "min_split_loss": 2.0, "min_child_weight": 20, "learning_rate": 0.1}
)

# With one split, the split feature explains a leaf's distance from the mean of both leaves, the other feature nothing.
O["boosted_attributions"] = first_tree(
    {"max_depth": 1},
    f""", two AS (SELECT *, -0.3::DOUBLE * gl / (nl + 1) AS vl, -0.3::DOUBLE * gr / (nr + 1) AS vr FROM best0),
size AS (SELECT *, (nl * abs(vl - (nl * vl + nr * vr) / n) + nr * abs(vr - (nl * vl + nr * vr) / n)) / n AS size FROM two)
SELECT {TARGET}, name AS feature, {r('CASE WHEN feature = k THEN size ELSE 0.0::DOUBLE END')} AS importance
FROM size, (VALUES (0, 'hour'), (1, 'weekday')) names(k, name)""",
)

# ---------------------------------------------------------------- streams

O["stream_features"] = f"WITH {OBS} SELECT * REPLACE ({r('value')} AS value), TIMESTAMP '{UPDATED}' AS update_date FROM obs"
O["stream_score"] = f"""WITH {ONE}, {FIT}, preds AS (SELECT {TARGET}, timestamp, value AS real_value,
  intercept + slope * lag_1 AS predictions FROM panel JOIN fit USING ({TARGET})), {QUARTILES}, {CHECKED}
SELECT {TARGET}, timestamp, real_value, {r('predictions')} AS predictions, {r('data_quality_percentage')} AS data_quality_percentage,
  validation_boolean FROM final"""
O["stream_lag_scores"] = O["stream_score"]
O["preprocess_look_back"] = O["preprocess_incremental"]
IN_RANGE = ONE.replace("WHERE lag_1 IS NOT NULL)", "WHERE lag_1 IS NOT NULL AND timestamp BETWEEN TIMESTAMP '{}' AND TIMESTAMP '{}')".format(*RANGE))
O["run_jobs_in_range"] = O["run_jobs"].replace(ONE, IN_RANGE)

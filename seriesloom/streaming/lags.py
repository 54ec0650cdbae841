"""Lag features of a stream, from keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seriesloom.functions.numbers import round_half_even
from seriesloom.operators.impute import complete_rows
from seriesloom.operators.merge import upsert_table, with_month
from seriesloom.operators.validate import TARGET, prediction_records
from seriesloom.plans.predict import score_with_registry
from seriesloom.schema import PREDICTIONS_KEY
from seriesloom.session import scratch_scope
from seriesloom.streaming.jobs import run_available

#: Rows of a series that may still be joined by late ones.
LATE_ROWS = 48


def amend(
    held: pd.DataFrame, cut: bool, new: pd.DataFrame, order: str, column: str, lags: Sequence[int], late_rows: int
) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The rows whose lags are new or other than before, the rows to hold from now on, and whether older ones were cut off.

    ``held`` is in order; the first ``max(lags)`` of a cut window serve as history only, so rows not newer than them are refused.
    """
    history = max(lags)
    if cut:
        new = new[new[order] > held[order].iloc[history - 1]]
    # Of one time the value of the later batch stays, in one batch the largest; a null replaces no value.
    new = new.sort_values([order, column], na_position="first", kind="stable")
    rows = pd.concat([held, new], ignore_index=True) if len(held) else new.reset_index(drop=True)
    by_value = np.argsort(rows[column].notna().to_numpy(), kind="stable")
    rows = rows.iloc[by_value].drop_duplicates(order, keep="last").sort_values(order, ignore_index=True)
    fresh = np.flatnonzero(rows[order].isin(new[order]).to_numpy())
    reached = np.zeros(len(rows) + history + 1, dtype=np.int64)
    np.add.at(reached, fresh, 1)
    np.add.at(reached, fresh + history + 1, -1)
    changed = np.cumsum(reached)[: len(rows)] > 0
    lagged = rows.assign(**{f"lag_{k}": rows[column].shift(k) for k in lags})[changed]
    keep = history + late_rows
    return lagged, rows.iloc[-keep:], cut or len(rows) > keep


def stream_lags(
    stream: DataFrame,
    keys: Sequence[str],
    column: str,
    lags: Sequence[int],
    carried: Sequence[str] = (),
    order: str = "timestamp",
    late_rows: int = LATE_ROWS,
    digits: int | None = 2,
) -> DataFrame:
    """(keys, order, column, carried, lag_k ...) of each new row of a series, by row position, as ``lag_features`` gives them.

    The state of a series is its last ``max(lags) + late_rows`` rows. A row may come late while fewer than ``late_rows`` newer ones
    have been seen: it takes its place, and the rows whose lags it moves are sent again, so an upsert of the output equals the
    batch result in any cut into batches; only a row that loses a lag to a late null keeps its last output. Later rows are
    refused, as are rows without a time. A time that comes again replaces the value. ``column`` and ``carried`` are numbers or texts. Rows of a series meet in one task per micro-batch, as these
    few columns: bound a micro-batch at the source (``files_per_batch``, ``maxOffsetsPerTrigger``).
    """
    keys, lags, carried = list(keys), list(lags), list(carried)
    if not lags or min(lags) < 1:
        raise ValueError("lags must be positive")
    if late_rows < 0:
        raise ValueError("late_rows must not be negative")
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    rows = stream.where(F.col(order).isNotNull()).select(
        *keys,
        F.unix_micros(F.col(order).cast("timestamp")).alias("_at"),
        F.col(column).cast("double").alias(column),
        *carried,
    )
    held = ["_at", column, *carried]
    held_types = [T.LongType(), T.DoubleType(), *[kinds[c] for c in carried]]
    state_type = T.StructType(
        [T.StructField("cut", T.BooleanType())] + [T.StructField(c, T.ArrayType(t)) for c, t in zip(held, held_types)]
    )
    out_type = T.StructType(
        [T.StructField(c, kinds[c]) for c in keys]
        + [T.StructField(c, t) for c, t in zip(held, held_types)]
        + [T.StructField(f"lag_{k}", T.DoubleType()) for k in lags]
    )

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cut, *values = state.get if state.exists else (False, *[[] for _ in held])
        window = pd.DataFrame(dict(zip(held, values))).astype({"_at": "int64", column: "float64"})
        new = pd.concat([f[held] for f in frames], ignore_index=True)
        changed, window, cut = amend(window, cut, new, "_at", column, lags, late_rows)
        state.update((cut, *[_plain(window[c]) for c in held]))
        yield changed.assign(**dict(zip(keys, key)))[[f.name for f in out_type.fields]]

    lagged = rows.groupBy(*keys).applyInPandasWithState(update, out_type, state_type, "append", GroupStateTimeout.NoTimeout)
    names = [f"lag_{k}" for k in lags]
    # NaN stands for null in pandas; the values themselves are finite numbers or missing.
    lagged = lagged.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in [column, *names]})
    lagged = lagged.withColumn(order, F.timestamp_micros("_at").cast(kinds[order])).drop("_at")
    whole = complete_rows(lagged, names)
    if digits is not None:
        whole = whole.withColumns({n: round_half_even(F.col(n), digits) for n in names})
    return whole.select(*keys, order, column, *carried, *names)


def _plain(values: pd.Series) -> list:
    """Values as the state's row encoder takes them."""
    return [None if pd.isna(v) else v for v in values.tolist()]


def stream_lag_scores(
    spark: SparkSession,
    stream: DataFrame,
    registry: Callable[[], DataFrame],
    thresholds: DataFrame,
    label: str,
    lags: Sequence[int],
    out: str,
    checkpoint: str,
    carried: Sequence[str] = (),
    update_date=None,
    accuracy_threshold: float = 85.0,
    late_rows: int = LATE_ROWS,
    digits: int | None = 2,
) -> DataFrame:
    """Score single observations of (location, target_variable, timestamp, label) as they come, with lags from the stream itself.

    Each row is scored by its series' best registered model of any kind and upserted as a prediction record.
    ``registry`` is read afresh for each batch, so a model registered meanwhile takes over. ``thresholds`` has one row per series.
    """
    features = stream_lags(stream, TARGET, label, lags, carried, "timestamp", late_rows, digits)

    def write(batch: DataFrame, _: int) -> None:
        with scratch_scope(spark):
            scored = score_with_registry(batch.where(F.col(label).isNotNull()), registry(), label)
            records = prediction_records(
                scored, accuracy_threshold=accuracy_threshold, update_date=update_date, thresholds=thresholds
            )
            upsert_table(spark, out, with_month(records), PREDICTIONS_KEY, ["target_variable", "month"])

    run_available(features, write, checkpoint)
    return spark.read.parquet(out).drop("month")

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

START = datetime(2024, 1, 1)


def hours(n):
    return [START + timedelta(hours=i) for i in range(n)]


def series(spark, values, key="a", times=None):
    times = times or hours(len(values))
    return spark.createDataFrame(
        [(key, t, v) for t, v in zip(times, values)], "k string, timestamp timestamp_ntz, value double"
    )


def values(df, column="value", order="timestamp"):
    return [r[column] for r in df.orderBy(order).collect()]


def gappy(n_series=3, n=400, share=0.7, seed=1, hot=None):
    """Random series with gaps; ``hot`` makes the first one that many times longer."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n_series):
        length = n * (hot or 1) if k == 0 else n
        for i in range(length):
            value = float(np.round(rng.normal(50, 20), 2)) if rng.random() > share else None
            rows.append((f"s{k}", START + timedelta(hours=i), value))
    return pd.DataFrame(rows, columns=["k", "timestamp", "value"])


def to_spark(spark, pdf):
    rows = [
        (k, t.to_pydatetime(), None if v is None or v != v else float(v))
        for k, t, v in pdf[["k", "timestamp", "value"]].itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "k string, timestamp timestamp_ntz, value double").repartition(4)


def by_series(df, column="value", order="timestamp"):
    pdf = df.select("k", order, column).toPandas().sort_values(["k", order])
    return {k: g[column].astype(float).to_numpy() for k, g in pdf.groupby("k")}


def same(a, b, tol=1e-9):
    assert a.keys() == b.keys()
    for k in a:
        np.testing.assert_allclose(np.asarray(a[k], float), np.asarray(b[k], float), rtol=tol, atol=tol)

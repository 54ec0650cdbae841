"""Standard scaling per series and polynomial features."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scale_fit(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, scaler): mean and population deviation of each column; a constant column gets 1."""
    entries = []
    for c in columns:
        std = F.stddev_pop(c)
        entries.append(
            F.struct(
                F.lit(c).alias("name"),
                F.avg(c).alias("mean"),
                F.when(std == 0, 1.0).otherwise(std).alias("std"),
            )
        )
    return df.groupBy(*keys).agg(F.array(*entries).alias("scaler"))


def scaler_rows(scalers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, name, mean, std): one row per column."""
    return scalers.select(*keys, F.inline("scaler"))


def scale_transform(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], scalers: DataFrame
) -> DataFrame:
    """Standardise the columns; ``scalers`` was fitted on the same columns in the same order."""

    def z(i: int, c: str) -> Column:
        s = F.get("_scaler", F.lit(i))
        return (F.col(c) - s["mean"]) / s["std"]

    return (
        df.join(scalers.select(*keys, F.col("scaler").alias("_scaler")), list(keys))
        .withColumns({c: z(i, c) for i, c in enumerate(columns)})
        .drop("_scaler")
    )


def inverse_scale(
    df: DataFrame, keys: Sequence[str], columns: dict[str, str], scalers: DataFrame
) -> DataFrame:
    """Undo the scaling of each column with the scaler entry it is mapped to, e.g.
    ``{"prediction": "value", "value": "value"}``. Columns are independent, so nothing else is needed."""
    wanted = sorted(set(columns.values()))

    def entry(name: str) -> Column:
        return F.get(F.filter("scaler", lambda s: s["name"] == name), F.lit(0)).alias(f"_s_{name}")

    small = scalers.select(*keys, *[entry(n) for n in wanted])
    out = df.join(small, list(keys)).withColumns(
        {c: F.col(c) * F.col(f"_s_{n}")["std"] + F.col(f"_s_{n}")["mean"] for c, n in columns.items()}
    )
    return out.drop(*[f"_s_{n}" for n in wanted])


def polynomial_terms(features: Sequence[str], degree: int = 2, bias: bool = False) -> dict[str, Column]:
    """Name to product, by degree: ``a``, ``b``, ``a^2``, ``a b``, ``b^2``; with ``bias`` also ``1``."""
    terms: dict[str, Column] = {"1": F.lit(1.0)} if bias else {}
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(features, d):
            powers = {f: combo.count(f) for f in combo}
            name = " ".join(f if n == 1 else f"{f}^{n}" for f, n in powers.items())
            product = F.col(combo[0])
            for f in combo[1:]:
                product = product * F.col(f)
            terms[name] = product
    return terms


def with_polynomial(
    df: DataFrame, features: Sequence[str], degree: int = 2, bias: bool = False
) -> tuple[DataFrame, list[str]]:
    """Add the terms to the columns; returns the frame and the terms' names in order."""
    terms = polynomial_terms(features, degree, bias)
    # The features themselves stay the same columns: renamed copies would multiply the constraints
    # the optimizer derives from them.
    return df.withColumns({k: v.cast("double") for k, v in terms.items() if k not in df.columns}), list(terms)


def with_named_terms(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the columns that ``names`` asks for and that are products of present ones (``a^2``, ``a b``).
    A name that is neither present nor such a product is an error."""
    missing: dict[str, Column] = {}
    for name in names:
        if name in df.columns or name == "1":
            continue
        product = F.lit(1.0)
        for factor in name.split(" "):
            base, _, power = factor.partition("^")
            if base not in df.columns or (power and not power.isdigit()):
                raise ValueError(f"a model needs {name!r}, which the rows neither have nor can derive")
            for _ in range(int(power or 1)):
                product = product * F.col(base).cast("double")
        missing[name] = product
    return df.withColumns(missing) if missing else df


def align_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the fitted features in order: missing ones are 0, others are dropped."""
    return df.select(
        *keep, *[(F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c) for c in names]
    )

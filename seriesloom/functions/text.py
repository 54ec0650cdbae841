"""String and null helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remove_literal(text: Column, literal: str = "valor_") -> Column:
    return F.replace(text, F.lit(literal), F.lit(""))


def strip_location(name: Column, location: Column) -> Column:
    """Remove every ``location/`` part from the name."""
    return F.replace(name, F.concat(location, F.lit("/")), F.lit(""))


def variable_key(latitude: Column, longitude: Column, target: Column, prefix: Column | None = None) -> Column:
    r"""``prefix\latitude\longitude\target``; a missing prefix is left out."""
    parts = [latitude.cast("string"), longitude.cast("string"), target]
    return F.concat_ws("\\", *([missing(prefix)] if prefix is not None else []), *parts)


def number_part(text: Column) -> Column:
    """First run of digits, 1 if there is none."""
    digits = F.regexp_extract(text, r"\d+", 0)
    return F.when(digits == "", F.lit(1)).otherwise(digits.try_cast("int"))


def unit_part(text: Column) -> Column:
    return F.regexp_extract(text, "[a-zA-Z]+", 0)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"\W+", "_")


def missing(text: Column) -> Column:
    """The texts that stand for nothing become null."""
    return F.when(text.isin("", "None"), F.lit(None)).otherwise(text)


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in floating})

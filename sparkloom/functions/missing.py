"""Null and NaN both mean missing."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned to null, so that aggregates skip it."""
    c = F.col(name)
    return F.when(~F.isnan(c), c) if is_float(df, name) else c


def number(df: DataFrame, name: str) -> Column:
    """The column as double, null where it is missing or no number."""
    c = present(df, name)
    return c.try_cast("double") if isinstance(df.schema[name].dataType, (T.StringType, T.BooleanType)) else c.cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return c.isNull() | F.isnan(c) if is_float(df, name) else c.isNull()


def filter_missing(df: DataFrame, name: str) -> DataFrame:
    """Rows with a number in ``name``, as double; others are dropped."""
    return df.withColumn(name, number(df, name)).filter(F.col(name).isNotNull())


def zero_filled(df: DataFrame, name: str) -> DataFrame:
    """All rows, 0.0 where ``name`` has no number."""
    return df.withColumn(name, F.coalesce(number(df, name), F.lit(0.0)))


def count_missing(df: DataFrame, *names: str) -> DataFrame:
    """One row: how many values of each column are null or NaN."""
    return df.agg(*[F.count_if(is_missing(df, n)).alias(n) for n in names or df.columns])


def count_values(df: DataFrame, name: str, values: Collection) -> DataFrame:
    """One row (n): rows whose value is one of ``values``; none of them missing."""
    return df.agg(F.count_if(F.col(name).isin(list(values))).alias("n"))


def count_zeros(df: DataFrame, name: str, zero_values: Collection = (0,)) -> DataFrame:
    return count_values(df, name, zero_values)

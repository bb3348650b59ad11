"""Grouping and reshaping."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions.aggs import Aggregate, aggregate
from sparkloom.functions.missing import number


def _names(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def group_aggregate(df: DataFrame, key: str | Sequence[str], value: str, how: Aggregate, order_by: Sequence[str] = ()) -> DataFrame:
    """Columns (keys, value), a row a group; with ``order_by`` groups come in order of first appearance."""
    keys = _names(key)
    found = df.groupBy(*keys).agg(aggregate(how, number(df, value)).alias("__value"), *([F.min(F.struct(*order_by)).alias("__first")] if order_by else []))
    if order_by:
        found = found.orderBy("__first")
    return found.select(*keys, F.col("__value").alias(value))


def group_transform(df: DataFrame, key: str | Sequence[str], value: str, how: Aggregate) -> DataFrame:
    """All rows, with the group's aggregate in ``<value>_transformed``.

    Groups are aggregated first and joined back, so a group with most of the rows is
    combined before it is shuffled, and its rows may be spread by a skew join.
    """
    keys = _names(key)
    groups = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(aggregate(how, number(df, value)).alias(f"{value}_transformed"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return df.join(groups, condition).drop(*[f"__{k}" for k in keys])


def group_filter(df: DataFrame, key: str | Sequence[str], value: str, how: Aggregate, keep: Callable[[Column], Column]) -> DataFrame:
    """Rows of the groups whose aggregate passes ``keep``."""
    name = f"{value}_transformed"
    return group_transform(df, key, value, how).filter(keep(F.col(name))).drop(name)


def pivot_table(df: DataFrame, index: str, columns: str, values: str, how: Aggregate = "sum", column_values: Sequence | None = None) -> DataFrame:
    """One row an index key and one column a column key, both sorted; NaN where nothing meets.

    Pass ``column_values`` to spare the pass over the data that finds them.
    """
    value = number(df, values)
    seen = df.withColumn("__value", value)
    if column_values is None:
        limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
        column_values = [r[0] for r in df.select(columns).filter(F.col(columns).isNotNull()).distinct().orderBy(columns).limit(limit + 1).collect()]
        if len(column_values) > limit:
            raise ValueError(f"over {limit} columns")
    if isinstance(how, str):
        wide = seen.groupBy(index).pivot(columns, list(column_values)).agg(aggregate(how, F.col("__value")))
    else:
        cells = seen.groupBy(index, columns).agg(aggregate(how, F.col("__value")).alias("__value"))
        wide = cells.groupBy(index).pivot(columns, list(column_values)).agg(F.first("__value", ignorenulls=True))
    filled = {n: F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(float("nan"))) for n in wide.columns if n != index}
    return wide.withColumns(filled).orderBy(index)


def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str], var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Long form: a row for each row and value column, in that order."""
    if not id_vars:
        raise ValueError("id_vars is required")
    return df.unpivot(list(id_vars), list(value_vars), var_name, value_name)


def unstack(df: DataFrame, index: str, var: str, value: str, order_by: Sequence[str], var_values: Sequence | None = None) -> DataFrame:
    """Wide form: the first value, in order, for each index key and variable; null where there is none."""
    order = F.struct(*order_by)
    if var_values is None:
        found = df.groupBy(var).agg(F.min(order).alias("__first")).orderBy("__first")
        var_values = [r[0] for r in found.filter(F.col(var).isNotNull()).collect()]
    wide = df.groupBy(index).pivot(var, list(var_values)).agg(F.min_by(F.col(value), order).alias("v"), F.min(order).alias("o"))
    first = F.least(*[F.col(f"`{v}_o`") for v in var_values]) if len(var_values) > 1 else F.col(f"`{var_values[0]}_o`")
    return wide.orderBy(first).select(index, *[F.col(f"`{v}_v`").alias(str(v)) for v in var_values])


def column_stats(df: DataFrame, name: str) -> DataFrame:
    """One row: total, mean, smallest and largest of the present numbers; nulls if there are none."""
    v = number(df, name)
    return df.agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("smallest"), F.max(v).alias("largest"))


def map_column(df: DataFrame, name: str, fn: Callable[[Column], Column]) -> DataFrame:
    """``fn`` of the column, as double, in its place."""
    return df.withColumn(name, fn(number(df, name)).cast("double"))


def map_python(df: DataFrame, name: str, fn: Callable[[float], float]) -> DataFrame:
    """As ``map_column``, for a Python function of one number; it runs on Arrow batches, and gaps stay gaps."""

    @F.pandas_udf("double")
    def each(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action="ignore").astype("float64")

    return df.withColumn(name, each(number(df, name)))

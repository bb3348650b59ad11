"""Aggregates by name, as native expressions; any other callable becomes a grouped pandas UDF."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "count": F.count,
    "median": F.median,
    "std": F.stddev_samp,
    "std_pop": F.stddev_pop,
    "var": F.var_samp,
    "var_pop": F.var_pop,
    "n_unique": F.countDistinct,
    "product": F.product,
}

Aggregate = str | Callable[[Sequence[float]], float]


def aggregate(how: Aggregate, value: Column) -> Column:
    """The expression for a named aggregate, or for a function of the present values of a group."""
    if isinstance(how, str):
        if how not in NAMED:
            raise ValueError(f"unknown aggregate {how!r}; known: {', '.join(sorted(NAMED))}")
        return NAMED[how](value)

    @F.pandas_udf("double")
    def custom(values: pd.Series) -> float:
        some = values.dropna().tolist()
        return float(how(some)) if some else None

    return custom(value)

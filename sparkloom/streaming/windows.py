"""Stateful operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.functions.aggs import aggregate


def resample_stream(stream: DataFrame, time: str, value: str, every: str, late: str, how: str = "mean", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, time, value): the aggregate of each step of ``every``, final once ``late`` has passed."""
    grouped = stream.withWatermark(time, late).groupBy(*keys, F.window(time, every))
    return grouped.agg(aggregate(how, F.col(value)).alias(value)).select(*keys, F.col("window.start").alias(time), value)


def ewm_stream(stream: DataFrame, key: str, time: str, value: str, alpha: float) -> DataFrame:
    """(key, time, ewm_mean) of every row; each key keeps one number between batches, and a batch is taken in order of time."""
    kind, when = stream.schema[key].dataType.simpleString(), stream.schema[time].dataType.simpleString()

    def step(found: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(time, kind="stable").dropna(subset=[value])
        mean = state.get[0] if state.exists else None
        out = []
        for x in rows[value].tolist():
            mean = x if mean is None else alpha * x + (1 - alpha) * mean
            out.append(mean)
        if mean is not None:
            state.update((mean,))
        yield pd.DataFrame({key: rows[key], time: rows[time], "ewm_mean": out})

    return stream.select(key, time, value).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{time}` {when}, ewm_mean double", "mean double", "append", GroupStateTimeout.NoTimeout)

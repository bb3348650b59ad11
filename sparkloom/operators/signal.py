"""Convolution, cross-correlation and the Fourier transform of an ordered series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.missing import number
from sparkloom.plans import with_ordinal, written


def _products(df: DataFrame, x: str, y: str, order_by: Sequence[str], max_rows: int, sign: int) -> tuple[DataFrame, int]:
    """Sums of x[i] y[j] by i + j, or by j - i, made block against block.

    Rows are gathered in blocks of positions; each pair of blocks is one row with two
    short arrays and gives its sums by numpy.  All products are needed, hence the limit.
    """
    rows = with_ordinal(df.withColumns({"__x": number(df, x), "__y": number(df, y)}), order_by, "i").select("i", "__x", "__y")
    rows = written(rows, "signal-rows")
    n = rows.count()
    if n > max_rows:
        raise ValueError(f"{n} rows; at most {max_rows}")
    size = max(256, -(-n // 64))
    nan = F.lit(float("nan"))
    blocks = rows.groupBy(F.floor(F.col("i") / size).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("__x", nan).alias("x"), F.coalesce("__y", nan).alias("y")))).alias("rows"))
    count = -(-n // size) or 1
    left = blocks.select(F.col("b").alias("p"), F.col("rows.x").alias("x")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    right = blocks.select(F.col("b").alias("q"), F.col("rows.y").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                a, b = np.asarray(r.x, dtype=float), np.asarray(r.y, dtype=float)
                if sign > 0:
                    yield pd.DataFrame({"at": r.p * size + r.q * size + np.arange(len(a) + len(b) - 1), "part": np.convolve(a, b)})
                else:
                    yield pd.DataFrame({"at": r.q * size - r.p * size + np.arange(-len(a) + 1, len(b)), "part": np.convolve(a[::-1], b)})

    parts = left.join(right, "q").mapInPandas(run, "at long, part double")
    return parts.groupBy("at").agg(F.sum(F.coalesce("part", nan)).alias("value")), n  # NaN comes back from pandas as null


def convolve(df: DataFrame, x: str, y: str, order_by: Sequence[str], max_rows: int = 1_000_000) -> DataFrame:
    """(i, conv): the full convolution, 2 n - 1 values; a missing value makes NaN of all it touches."""
    found, _ = _products(df, x, y, order_by, max_rows, 1)
    return found.select(F.col("at").alias("i"), F.col("value").alias("conv"))


def cross_correlate(df: DataFrame, x: str, y: str, order_by: Sequence[str], max_rows: int = 1_000_000) -> DataFrame:
    """(lag, xcorr): sums of x[i] y[i + lag] for lags from -(n - 1) to n - 1."""
    found, _ = _products(df, x, y, order_by, max_rows, -1)
    return found.select(F.col("at").alias("lag"), F.col("value").alias("xcorr"))


def fft(df: DataFrame, time: str, value: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """(keys, frequency, real, imag), series by series, in cycles a second by the first time step.

    Times must be timestamps; missing values count as NaN.  Fewer than two rows give none.
    """
    keys = list(partition_by)
    rows = df.select(*keys, (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("__t"), number(df, value).alias("__x"))
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["frequency double", "real double", "imag double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__t", kind="stable")
        n = len(group)
        if n < 2:
            return pd.DataFrame({c: [] for c in [*keys, "frequency", "real", "imag"]})
        step = group["__t"].iloc[1] - group["__t"].iloc[0]
        found = np.fft.fft(group["__x"].to_numpy(dtype=float))
        out = pd.DataFrame({"frequency": np.arange(n) / (n * step), "real": found.real, "imag": found.imag})
        for k in keys:
            out[k] = group[k].iloc[0]
        return out[[*keys, "frequency", "real", "imag"]]

    found = rows.groupBy(*keys).applyInPandas(run, schema)
    return found.withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in ("real", "imag")})

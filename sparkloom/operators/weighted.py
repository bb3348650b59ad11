"""Weighted quantiles and histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.missing import number
from sparkloom.plans import running


def _positive(df: DataFrame, value: str, weight: str) -> DataFrame:
    rows = df.select(number(df, value).alias("v"), number(df, weight).alias("w"))
    return rows.filter("v is not null and w > 0")


def weighted_quantile(df: DataFrame, value: str, weight: str, qs: Sequence[float] = (0.5,)) -> DataFrame:
    """(q, value): the smallest value whose weight with all below reaches q of the whole; NaN without positive weights."""
    steps = running(_positive(df, value, weight).groupBy("v").agg(F.sum("w").alias("w")), ["v"], {"up_to": F.col("w")})
    total = steps.agg(F.max("up_to")).first()[0]
    reached = [F.min(F.when(F.col("up_to") >= F.lit(q * (total or 0.0) * (1 - 1e-12)), F.col("v"))).alias(f"q{i}") for i, q in enumerate(qs)]
    row = steps.agg(*reached)
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.coalesce(F.col(f"q{i}"), F.lit(float("nan"))).alias("value")) for i, q in enumerate(qs)])
    return row.select(F.explode(pairs).alias("p")).select("p.q", "p.value")


def weighted_histogram(df: DataFrame, value: str, weight: str, bins: int | None = None) -> DataFrame:
    """(binStart, binEnd, weight): equal bins over the values' range; their number by Freedman and Diaconis unless given.

    Equal values make one bin; no rows make none.
    """
    rows = _positive(df, value, weight)
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return rows.select(F.col("v").alias("binStart"), F.col("v").alias("binEnd"), F.col("w").alias("weight"))
    if bins is None and high > low:
        q = {r["q"]: r["value"] for r in weighted_quantile(df, value, weight, (0.25, 0.75)).collect()}
        width = 2 * (q[0.75] - q[0.25]) / n ** (1 / 3)
        bins = max(1, math.ceil((high - low) / width)) if width > 0 else 1
    bins = max(1, bins or 1) if high > low else 1
    width = (high - low) / bins
    index = F.least(F.floor((F.col("v") - low) / (width or 1.0)), F.lit(bins - 1)).cast("long")
    sums = rows.groupBy(index.alias("id")).agg(F.sum("w").alias("weight"))
    spine = df.sparkSession.range(bins)
    start = F.lit(low) + F.col("id") * F.lit(width)
    return spine.join(sums, "id", "left").select(start.alias("binStart"), (start + F.lit(width)).alias("binEnd"), F.coalesce("weight", F.lit(0.0)).alias("weight"))

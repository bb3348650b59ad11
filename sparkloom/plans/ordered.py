"""Row order without a single-task window.

A table is range-partitioned by its order and stored, so that counts and rows see the
same partitioning.  Windows then run within partitions, and what lies before a
partition comes from one small row for each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.plans.stored import written

PART, ORD, PLACE = "__part", "__ord", "__place"


def ranged(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """``df`` stored in ranges of its order, numbered in column ``__part``."""
    return written(df.repartitionByRange(*order_by).withColumn(PART, F.spark_partition_id()), "ranges")


def _before(sums: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sums of all earlier parts; one row a part."""
    earlier = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(PART, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}__before") for n in names])


def with_ordinal(df: DataFrame, order_by: Sequence[str | Column], name: str = ORD) -> DataFrame:
    """Adds a gapless 0-based number in the given order; rows that tie in it are numbered in any order."""
    parts = ranged(df, order_by)
    before = _before(parts.groupBy(PART).agg(F.count(F.lit(1)).alias("n")), ["n"])
    within = F.row_number().over(W.partitionBy(PART).orderBy(*order_by)) - 1
    numbered = parts.withColumn("__within", within).join(F.broadcast(before), PART)  # one row a partition
    return numbered.withColumn(name, (F.col("n__before") + F.col("__within")).cast("long")).drop(PART, "__within", "n__before")


def running(df: DataFrame, order_by: Sequence[str | Column], totals: dict[str, Column], partition_by: Sequence[str] = ()) -> DataFrame:
    """Adds running sums, each row included: ``totals`` maps new names to the values added up."""
    if partition_by:
        window = W.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(v).over(window) for n, v in totals.items()})
    parts = ranged(df.withColumns({f"{n}__value": v for n, v in totals.items()}), order_by)
    before = _before(parts.groupBy(PART).agg(*[F.sum(f"{n}__value").alias(n) for n in totals]), list(totals))
    window = W.partitionBy(PART).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    joined = parts.join(F.broadcast(before), PART)
    out = joined.withColumns({n: F.coalesce(F.sum(f"{n}__value").over(window), F.lit(0)) + F.col(f"{n}__before") for n in totals})
    return out.drop(PART, *[f"{n}__value" for n in totals], *[f"{n}__before" for n in totals])


def running_extremes(df: DataFrame, order_by: Sequence[str | Column], extremes: dict[str, tuple[str, Column]], partition_by: Sequence[str] = ()) -> DataFrame:
    """Adds running minima and maxima: ``extremes`` maps new names to ("min" or "max", values)."""
    pick: dict[str, Callable] = {"min": F.min, "max": F.max}
    both: dict[str, Callable] = {"min": F.least, "max": F.greatest}
    if partition_by:
        window = W.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({n: pick[k](v).over(window) for n, (k, v) in extremes.items()})
    parts = ranged(df.withColumns({f"{n}__value": v for n, (_, v) in extremes.items()}), order_by)
    sums = parts.groupBy(PART).agg(*[pick[k](f"{n}__value").alias(n) for n, (k, _) in extremes.items()])
    earlier = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(PART, *[pick[k](n).over(earlier).alias(f"{n}__before") for n, (k, _) in extremes.items()])
    window = W.partitionBy(PART).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    out = parts.join(F.broadcast(before), PART).withColumns({n: both[k](pick[k](f"{n}__value").over(window), F.col(f"{n}__before")) for n, (k, _) in extremes.items()})
    return out.drop(PART, *[f"{n}__value" for n in extremes], *[f"{n}__before" for n in extremes])


def sliding(
    df: DataFrame, order_by: Sequence[str | Column], before: int, after: int, columns: Callable[[object], dict[str, Column]], partition_by: Sequence[str] = (), block: int = 65_536
) -> DataFrame:
    """Adds columns over the frame of ``before`` rows before to ``after`` rows after each row.

    ``columns`` gets the framed window.  With ``partition_by`` that is an ordinary
    window.  A single series is cut into blocks of ``block`` rows by ordinal, and rows
    near a block's edge are lent to the neighbours whose frames reach them.
    """
    if partition_by:
        window = W.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(-before, after)
        return df.withColumns(columns(window))
    size = max(block, before + after + 1)
    numbered = with_ordinal(df, order_by, PLACE)
    first, last = F.floor((F.col(PLACE) - after) / size), F.floor((F.col(PLACE) + before) / size)
    lent = numbered.withColumn("__block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    window = W.partitionBy("__block").orderBy(PLACE).rowsBetween(-before, after)
    framed = lent.withColumns(columns(window)).filter(F.col("__block") == F.floor(F.col(PLACE) / size))
    return framed.drop("__block", PLACE)

"""Covariance, hypothesis tests and the bootstrap: one aggregation each, the rest on a few numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.aggs import Aggregate, aggregate
from sparkloom.functions.missing import filter_missing, number
from sparkloom.functions.special import chi2_upper, f_upper, t_two_sided
from sparkloom.plans import with_ordinal, written


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as x0, x1, ... of rows where all are numbers."""
    rows = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    for n in rows.columns:
        rows = rows.filter(F.col(n).isNotNull())
    return rows


def covariance_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a column (``column`` names it) of population covariances over complete rows."""
    p = len(columns)
    rows = complete(df, columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    one = rows.agg(*[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs])
    cell = lambda i, j: F.col(f"c{min(i, j)}_{max(i, j)}")
    lines = F.array(*[F.struct(F.lit(columns[i]).alias("column"), *[cell(i, j).alias(columns[j]) for j in range(p)]) for i in range(p)])
    return one.select(F.explode(lines).alias("l")).select("l.*")


@dataclass(frozen=True)
class TTest:
    t: float
    df: float
    p_value: float


@dataclass(frozen=True)
class Anova:
    f: float
    df_between: int
    df_within: int
    p_value: float
    eta_squared: float


@dataclass(frozen=True)
class ChiSquare:
    chi2: float
    dof: int
    p_value: float
    observed: DataFrame
    expected: DataFrame


@dataclass(frozen=True)
class Bootstrap:
    samples: DataFrame

    def percentile_ci(self, level: float = 0.95) -> tuple[float, float]:
        """The interval between the order statistics that cut off equal tails."""
        ordered = [r["sample"] for r in self.samples.filter("sample is not null").orderBy("sample").collect()]
        n, tail = len(ordered), (1 - level) / 2
        return ordered[min(n - 1, math.floor(tail * n))], ordered[max(0, math.ceil((1 - tail) * n) - 1)]


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, variance with divisor n - 1) of the present numbers."""
    rows = filter_missing(df, value).filter(F.col(group).isNotNull())
    return rows.groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def t_test(df: DataFrame, group: str, value: str) -> TTest:
    """Welch's test between the two groups, in order of their keys."""
    found = group_moments(df, group, value).orderBy("group").limit(3).collect()
    if len(found) != 2:
        raise ValueError("a t-test needs exactly two groups")
    a, b = found
    if min(a["n"], b["n"]) < 2:
        raise ValueError("each group needs two values or more")
    sa, sb = a["variance"] / a["n"], b["variance"] / b["n"]
    if sa + sb == 0:
        return TTest(float("nan"), float("nan"), float("nan"))
    t = (a["mean"] - b["mean"]) / math.sqrt(sa + sb)
    dof = (sa + sb) ** 2 / (sa**2 / (a["n"] - 1) + sb**2 / (b["n"] - 1))
    return TTest(t, dof, t_two_sided(t, dof))


def anova(df: DataFrame, group: str, value: str) -> Anova:
    """One-way analysis of variance."""
    groups = group_moments(df, group, value)
    n, k, total = F.col("n"), F.count(F.lit(1)), F.sum("n")
    one = groups.agg(k.alias("k"), total.alias("n"), (F.sum(n * F.col("mean")) / total).alias("mean")).first()
    if not one["k"] or one["k"] < 2 or one["n"] <= one["k"]:
        raise ValueError("anova needs two groups, and more values than groups")
    apart = F.col("mean") - F.lit(one["mean"])
    sums = groups.agg(F.sum(n * apart * apart).alias("between"), F.sum((n - 1) * F.coalesce("variance", F.lit(0.0))).alias("within")).first()
    d1, d2 = one["k"] - 1, one["n"] - one["k"]
    f = (sums["between"] / d1) / (sums["within"] / d2) if sums["within"] else math.inf
    whole = sums["between"] + sums["within"]
    return Anova(f, d1, d2, f_upper(f, d1, d2) if f < math.inf else 0.0, sums["between"] / whole if whole else float("nan"))


def chi_square(df: DataFrame, x: str, y: str) -> ChiSquare:
    """Pearson's test of independence; observed and expected are long tables (x, y, n)."""
    cells = written(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n")), "cells")
    rows, columns = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        raise ValueError("no complete rows")
    # The table of all pairs of keys is the result itself.
    table = rows.crossJoin(columns).join(cells, ["x", "y"], "left")
    expected = F.col("nx") * F.col("ny") / F.lit(float(total))
    table = table.select("x", "y", F.coalesce("n", F.lit(0)).alias("n"), expected.alias("e"))
    chi2 = table.agg(F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e"))).first()[0]
    dof = (rows.count() - 1) * (columns.count() - 1)
    return ChiSquare(chi2, dof, chi2_upper(chi2, dof) if dof else 1.0, table.select("x", "y", "n"), table.select("x", "y", F.col("e").alias("n")))


def bootstrap(df: DataFrame, value: str, statistic: Aggregate = "mean", n_boot: int = 1000, seed: int = 0) -> Bootstrap:
    """(replicate, sample): the statistic of ``n_boot`` resamples with replacement, fixed by ``seed``.

    Draws are made where they are counted: every (replicate, draw) picks a row number
    by hash and meets the rows by it.
    """
    rows = with_ordinal(filter_missing(df, value).select(value), [value], "i")
    n = rows.count()
    if not n:
        raise ValueError("no values")
    draws = df.sparkSession.range(n * n_boot).select(F.floor(F.col("id") / n).alias("replicate"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("i"))
    samples = draws.join(rows, "i").groupBy("replicate").agg(aggregate(statistic, F.col(value)).cast("double").alias("sample"))
    return Bootstrap(samples)

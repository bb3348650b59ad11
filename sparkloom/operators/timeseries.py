"""Time series: resampling, autocorrelation, decomposition, smoothing and interpolation."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.aggs import Aggregate, aggregate
from sparkloom.functions.missing import filter_missing, number
from sparkloom.operators.windows import by_series
from sparkloom.plans import running, sliding, with_ordinal


class Method(Enum):
    POLYNOMIAL = "polynomial"
    LINEAR = "linear"
    SPLINE = "spline"
    TIME = "time"


def resample(df: DataFrame, time: str, value: str, seconds: float, how: Aggregate = "mean", interpolation: str = "linear", partition_by: Sequence[str] = ()) -> DataFrame:
    """(keys, time, value) on a grid of steps of ``seconds`` from each series' first time to its last.

    A step takes the aggregate of the values within it; an empty one lies on the line
    between the rows around it, or is NaN if ``interpolation`` isn't ``linear``.  Rows
    without a value or a time are left out.  Steps and rows meet by step number, and
    each row carries its successor, so no row is compared with all others.
    """
    keys, step = list(partition_by), int(round(seconds * 1_000_000))
    rows = filter_missing(df, value).filter(F.col(time).isNotNull())
    rows = rows.withColumn("__us", F.unix_micros(F.col(time).cast("timestamp")))
    rows = rows.groupBy(*keys, "__us").agg(F.collect_list(value).alias("__values"), F.last(value).alias("__last"), F.first(value).alias("__head"))
    ends = rows.groupBy(*keys).agg(F.min("__us").alias("__low"), F.max("__us").alias("__high"))
    ends = ends if keys else ends.withColumn("__one", F.lit(0))
    rows = rows if keys else rows.withColumn("__one", F.lit(0))
    on = keys or ["__one"]
    placed = rows.join(F.broadcast(ends) if not keys else ends, on)  # without keys, one row
    placed = placed.withColumn("__step", F.floor((F.col("__us") - F.col("__low")) / step))
    # The successor of a row is looked for only among rows at other times.
    placed = sliding(placed, ["__us"], 0, 1, lambda w: {"__ahead": F.last(F.struct("__us", "__head")).over(w), "__rows": F.count(F.lit(1)).over(w)}, keys)
    ahead = F.when(F.col("__rows") > 1, F.col("__ahead"))
    placed = placed.withColumn("__us1", ahead["__us"]).withColumn("__v1", ahead["__head"])
    last_step = F.floor((F.col("__high") - F.col("__low")) / step)
    reach = F.when(F.col("__us1").isNotNull(), F.floor((F.col("__us1") - F.col("__low") - 1) / step)).otherwise(F.col("__step"))
    filled = placed.withColumn("__grid", F.explode(F.sequence(F.col("__step"), F.greatest(F.col("__step"), F.least(reach, last_step)))))
    at = F.col("__low") + F.col("__grid") * step
    part = (at - F.col("__us")) / (F.col("__us1") - F.col("__us"))
    line = F.when(F.col("__grid") > F.col("__step"), F.col("__last") + (F.col("__v1") - F.col("__last")) * part)
    own = F.when(F.col("__grid") == F.col("__step"), F.col("__values"))
    flat = filled.select(*on, F.col("__low"), "__grid", line.alias("__line"), F.explode_outer(own).alias("__value"))
    found = flat.groupBy(*on, "__grid").agg(aggregate(how, F.col("__value")).cast("double").alias("__agg"), F.max("__line").alias("__line"), F.min("__low").alias("__low"))
    gap = F.col("__line") if interpolation == "linear" else F.lit(None).cast("double")
    kind = df.schema[time].dataType
    when = F.timestamp_micros(F.col("__low") + F.col("__grid") * step)
    return found.select(*keys, when.cast(kind).alias(time), F.coalesce("__agg", gap, F.lit(float("nan"))).alias(value))


def _lag_products(df: DataFrame, value: str, max_lag: int, order_by: Sequence[str]) -> tuple[int, list[float]]:
    """Number of values, and sums of products of centred values at each lag, in one pass."""
    rows = filter_missing(df, value)
    mean = rows.agg(F.avg(value)).first()[0] or 0.0
    centred = rows.select(*order_by, (F.col(value) - F.lit(mean)).alias("__x"))
    framed = sliding(centred, order_by, max_lag, 0, lambda w: {"__w": F.collect_list("__x").over(w)})
    earlier = lambda k: F.get("__w", F.size("__w") - 1 - k)
    row = framed.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("__x") * earlier(k)).alias(f"s{k}") for k in range(max_lag + 1)]).first()
    return row["n"], [row[f"s{k}"] or 0.0 for k in range(max_lag + 1)]


def autocorrelation(df: DataFrame, value: str, max_lag: int, order_by: Sequence[str]) -> list[float]:
    """Mean product at each lag over the population variance."""
    n, s = _lag_products(df, value, max_lag, order_by)
    return [(s[k] / (n - k)) / (s[0] / n) if n > k and s[0] else float("nan") for k in range(max_lag + 1)]


def partial_autocorrelation(df: DataFrame, value: str, max_lag: int, order_by: Sequence[str]) -> list[float]:
    """Durbin-Levinson recursion on autocovariances with divisor n; [1.0] for lag 0."""
    n, s = _lag_products(df, value, max_lag, order_by)
    if not s[0]:
        return [1.0] + [float("nan")] * max_lag
    rho = np.array(s) / s[0]
    out, phi, left = [1.0], np.zeros(0), 1.0
    for k in range(1, max_lag + 1):
        new = (rho[k] - phi @ rho[k - 1 : 0 : -1][: k - 1]) / left
        phi = np.append(phi - new * phi[::-1], new)
        left *= 1 - new * new
        out.append(float(new))
    return out


def seasonal_decompose(df: DataFrame, value: str, period: int, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Adds trend, seasonal and residual: centred mean, mean of each phase without trend, and the rest; NaN at the ends."""
    if period < 1:
        raise ValueError("the period must be at least 1")
    keys = list(partition_by)
    rows = df.withColumn("__x", number(df, value))
    if keys:
        rows = running(rows, order_by, {"__n": F.lit(1)}, keys).withColumn("__i", F.col("__n") - 1).drop("__n")
    else:
        rows = with_ordinal(rows, order_by, "__i")
    back, ahead = period // 2, (period - 1) // 2
    framed = sliding(rows, ["__i"], back, ahead, lambda w: {"__full": F.count("__x").over(w), "__mean": F.avg("__x").over(w)}, keys)
    trend = framed.withColumn("__trend", F.when(F.col("__full") == period, F.col("__mean"))).withColumn("__phase", F.col("__i") % period)
    phases = trend.groupBy(*keys, "__phase").agg(F.avg(F.col("__x") - F.col("__trend")).alias("__seasonal"))
    nan = F.lit(float("nan"))
    joined = trend.join(phases, [*keys, "__phase"], "left")
    return joined.select(
        *df.columns, F.coalesce("__trend", nan).alias("trend"), F.coalesce("__seasonal", nan).alias("seasonal"),
        F.coalesce(F.col("__x") - F.col("__trend") - F.col("__seasonal"), nan).alias("residual"),
    )


def smoothed(x: np.ndarray, method: str, period: int, alpha: float, beta: float, gamma: float, seasonal: str) -> dict[str, np.ndarray]:
    """level, trend, seasonal and fitted of one series, as far as the method has them.

    ``ses``: fitted is the level.  ``holt``: level and trend begin with the first value
    and step; fitted is their sum after the update.  ``hw``: the first season is taken
    as it is, with its mean as level and the step between two seasons' means as trend.
    """
    n = len(x)
    level, trend, season, fitted = (np.full(n, np.nan) for _ in range(4))
    if method == "ses":
        for t in range(n):
            level[t] = x[t] if t == 0 else alpha * x[t] + (1 - alpha) * level[t - 1]
        return {"level": level, "fitted": level.copy()}
    if method == "holt":
        if n < 2:
            raise ValueError("holt needs two values or more")
        level[0], trend[0], fitted[0] = x[0], x[1] - x[0], x[0]
        for t in range(1, n):
            level[t] = alpha * x[t] + (1 - alpha) * (level[t - 1] + trend[t - 1])
            trend[t] = beta * (level[t] - level[t - 1]) + (1 - beta) * trend[t - 1]
            fitted[t] = level[t] + trend[t]
        return {"level": level, "trend": trend, "fitted": fitted}
    if n < 2 * period:
        raise ValueError("hw needs two whole seasons")
    times = seasonal == "multiplicative"
    one, two = x[:period].mean(), x[period : 2 * period].mean()
    level[period - 1], trend[period - 1] = one, (two - one) / period
    season[:period], fitted[:period] = (x[:period] / one if times else x[:period] - one), x[:period]
    for t in range(period, n):
        base, old = level[t - 1] + trend[t - 1], season[t - period]
        level[t] = alpha * (x[t] / old if times else x[t] - old) + (1 - alpha) * base
        trend[t] = beta * (level[t] - level[t - 1]) + (1 - beta) * trend[t - 1]
        season[t] = gamma * (x[t] / base if times else x[t] - base) + (1 - gamma) * old
        fitted[t] = (level[t] + trend[t]) * old if times else level[t] + trend[t] + old
    return {"level": level, "trend": trend, "seasonal": season, "fitted": fitted}


def exponential_smoothing(
    df: DataFrame, value: str, period: int, order_by: Sequence[str], partition_by: Sequence[str] = (), method: str = "ses",
    alpha: float = 0.5, beta: float = 0.5, gamma: float = 0.5, seasonal: str = "additive",
) -> DataFrame:
    """Adds observed, level, trend (holt, hw), seasonal (hw) and fitted, series by series."""
    if method not in ("ses", "holt", "hw") or seasonal not in ("additive", "multiplicative"):
        raise ValueError("method is ses, holt or hw; seasonal is additive or multiplicative")
    names = {"ses": ["level"], "holt": ["level", "trend"], "hw": ["level", "trend", "seasonal"]}[method]
    rows = filter_missing(df, value).withColumn("observed", F.col(value))
    return by_series(rows, order_by, partition_by, dict.fromkeys([*names, "fitted"], "double"), lambda g: smoothed(g[value].to_numpy(), method, period, alpha, beta, gamma, seasonal))


def linear_at(x: float, xs: Sequence[float], ys: Sequence[float]) -> float:
    """On the segment around ``x``, or on the first or last one carried on."""
    if len(xs) < 2:
        raise ValueError("linear interpolation needs two points")
    j = min(max(int(np.searchsorted(xs, x, side="left")) - 1, 0), len(xs) - 2)
    return ys[j] + (ys[j + 1] - ys[j]) * (x - xs[j]) / (xs[j + 1] - xs[j])


def lagrange_at(x: float, xs: Sequence[float], ys: Sequence[float]) -> float:
    """The polynomial through all points, by Neville's scheme."""
    p, xs = [float(y) for y in ys], [float(v) for v in xs]
    for width in range(1, len(xs)):
        for i in range(len(xs) - width):
            p[i] = ((x - xs[i + width]) * p[i] + (xs[i] - x) * p[i + 1]) / (xs[i] - xs[i + width])
    return p[0]


def spline_at(x: float, xs: Sequence[float], ys: Sequence[float]) -> float:
    """The natural cubic spline; outside the points, the first piece carried on."""
    if len(xs) < 2:
        raise ValueError("spline interpolation needs two points")
    xs, ys = np.asarray(xs, dtype=float), np.asarray(ys, dtype=float)
    h, n = np.diff(xs), len(xs)
    slope = np.diff(ys) / h
    bend = np.zeros(n)  # second derivatives, 0 at both ends
    if n > 2:
        system = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        bend[1:-1] = np.linalg.solve(system, 6 * np.diff(slope))
    j = int(np.searchsorted(xs, x, side="left")) - 1 if xs[0] < x <= xs[-1] else 0
    a, b = xs[j + 1] - x, x - xs[j]
    return float((bend[j] * a**3 + bend[j + 1] * b**3) / (6 * h[j]) + (ys[j] / h[j] - bend[j] * h[j] / 6) * a + (ys[j + 1] / h[j] - bend[j + 1] * h[j] / 6) * b)


_AT = {Method.POLYNOMIAL: lagrange_at, Method.SPLINE: spline_at, Method.TIME: linear_at, Method.LINEAR: linear_at}


def interpolated(x: np.ndarray, y: np.ndarray, method: Method, degree: int, precision: int | None) -> np.ndarray:
    """``y`` with gaps filled from the ``degree + 1`` known points nearest by ``x``; ``linear`` draws its lines over row numbers."""
    known = np.flatnonzero(~np.isnan(y))
    known = known[np.argsort(x[known], kind="stable")]
    places_of, out, k = x[known], y.copy(), degree + 1
    for i in np.flatnonzero(np.isnan(y)):
        j = int(np.searchsorted(places_of, x[i]))
        # The k on either side hold the k nearest; those at the same place as the furthest may be ahead of it.
        low = int(np.searchsorted(places_of, places_of[max(0, j - k)])) if len(known) else 0
        near = np.sort(known[low : j + k])
        near = near[np.argsort(np.abs(x[near] - x[i]), kind="stable")[:k]]
        near = near[np.argsort(x[near], kind="stable")]
        at, places = (float(i), near.astype(float)) if method is Method.LINEAR else (x[i], x[near])
        if not len(near):
            continue
        found = _AT[method](at, places, y[near])
        out[i] = found if precision is None else round(found, precision)
    return out


def interpolate(
    df: DataFrame, at: str, value: str, partition_by: Sequence[str] = (), method: Method | str = Method.POLYNOMIAL, degree: int = 3, precision: int | None = None
) -> DataFrame:
    """Fills gaps of ``value`` along ``at`` (numbers, or times counted in seconds), series by series."""
    how = Method(method)
    timed = isinstance(df.schema[at].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    x = F.unix_micros(F.col(at).cast("timestamp")) / 1e6 if timed else F.col(at).cast("double")
    rows = df.withColumn(value, number(df, value)).withColumn("__at", x).filter(F.col("__at").isNotNull())

    def fill(g: pd.DataFrame) -> dict[str, np.ndarray]:
        return {"__filled": interpolated(g["__at"].to_numpy(dtype=float), g[value].to_numpy(dtype=float), how, degree, precision)}

    found = by_series(rows, ["__at"], partition_by, {"__filled": "double"}, fill)
    return found.withColumn(value, F.col("__filled")).drop("__filled", "__at")

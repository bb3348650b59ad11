"""Rolling, expanding and exponentially weighted windows.

``order_by`` is the row order; ``partition_by`` names series that are independent.
Rows without a number are left out first, as the frames count numbers only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.aggs import Aggregate, aggregate
from sparkloom.functions.missing import filter_missing, number
from sparkloom.plans import running, running_extremes, sliding
from sparkloom.plans.ordered import PART, ranged



def _rolled(df: DataFrame, value: str, width: int, order_by: Sequence[str], partition_by: Sequence[str], out: str, of: Callable[[Column, object], Column]) -> DataFrame:
    if width <= 0:
        raise ValueError("the window must have a row or more")
    rows = filter_missing(df, value)

    def columns(window: object) -> dict[str, Column]:
        full = F.count(F.lit(1)).over(window) == width
        return {out: F.when(full, of(F.col(value), window)).otherwise(float("nan"))}

    return sliding(rows, order_by, width - 1, 0, columns, partition_by)


def rolling_sum(df: DataFrame, value: str, width: int, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "rolling_sum") -> DataFrame:
    """Sum of the last ``width`` numbers; NaN until there are as many."""
    return _rolled(df, value, width, order_by, partition_by, out, lambda c, w: F.sum(c).over(w))


def rolling_mean(df: DataFrame, value: str, width: int, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "rolling_mean") -> DataFrame:
    return _rolled(df, value, width, order_by, partition_by, out, lambda c, w: F.avg(c).over(w))


def rolling_std(df: DataFrame, value: str, width: int, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "rolling_std") -> DataFrame:
    """Population standard deviation."""
    return _rolled(df, value, width, order_by, partition_by, out, lambda c, w: F.stddev_pop(c).over(w))


def rolling_apply(df: DataFrame, value: str, width: int, how: Aggregate, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "rolling_apply") -> DataFrame:
    """A named aggregate, or a function of the window's numbers in order."""
    if isinstance(how, str):
        return _rolled(df, value, width, order_by, partition_by, out, lambda c, w: aggregate(how, c).over(w).cast("double"))

    @F.pandas_udf("double")
    def each(lists: pd.Series) -> pd.Series:
        return pd.Series([float(how(list(x))) if len(x) == width else float("nan") for x in lists])

    if width <= 0:
        raise ValueError("the window must have a row or more")
    framed = sliding(filter_missing(df, value), order_by, width - 1, 0, lambda w: {"__window": F.collect_list(value).over(w)}, partition_by)
    return framed.withColumn(out, F.coalesce(each("__window"), F.lit(float("nan")))).drop("__window")


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def rolling_mad(df: DataFrame, value: str, width: int, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Median distance from the window's median, in ``<value>_rollingMAD``; rows without a number stay, and windows skip them."""
    if width <= 0:
        raise ValueError("the window must have a row or more")
    out = f"{value}_rollingMAD"
    rows = df.withColumn("__number", number(df, value))
    framed = sliding(rows, order_by, width - 1, 0, lambda w: {"__window": F.collect_list("__number").over(w), "__rows": F.count(F.lit(1)).over(w)}, partition_by)

    def mad(window: Column) -> Column:
        return F.transform(F.array(_median(window)), lambda m: _median(F.transform(window, lambda x: F.abs(x - m))))[0]

    found = F.when(F.col("__rows") == width, F.coalesce(mad(F.col("__window")), F.lit(float("nan")))).otherwise(float("nan"))
    return framed.withColumn(out, found).drop("__number", "__window", "__rows")


def expanding_min(df: DataFrame, value: str, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "expanding_min") -> DataFrame:
    return running_extremes(filter_missing(df, value), order_by, {out: ("min", F.col(value))}, partition_by)


def expanding_max(df: DataFrame, value: str, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "expanding_max") -> DataFrame:
    return running_extremes(filter_missing(df, value), order_by, {out: ("max", F.col(value))}, partition_by)


def expanding_mean(df: DataFrame, value: str, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "expanding_mean") -> DataFrame:
    found = running(filter_missing(df, value), order_by, {"__sum": F.col(value), "__n": F.lit(1)}, partition_by)
    return found.withColumn(out, F.col("__sum") / F.col("__n")).drop("__sum", "__n")


def expanding_var(df: DataFrame, value: str, order_by: Sequence[str], partition_by: Sequence[str] = (), ddof: int = 1, out: str = "expanding_var") -> DataFrame:
    """Variance with divisor n - ddof; NaN while n <= ddof.  Values are shifted by their mean so that squares cancel little."""
    rows = filter_missing(df, value)
    centre = rows.agg(F.avg(value)).first()[0] or 0.0
    x = F.col(value) - F.lit(centre)
    found = running(rows, order_by, {"__sum": x, "__squares": x * x, "__n": F.lit(1)}, partition_by)
    n = F.col("__n")
    spread = F.greatest(F.col("__squares") - F.col("__sum") * F.col("__sum") / n, F.lit(0.0))
    return found.withColumn(out, F.when(n > ddof, spread / F.greatest(n - ddof, F.lit(1))).otherwise(float("nan"))).drop("__sum", "__squares", "__n")


def by_series(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str], schema_of: dict[str, str], fn: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """Adds columns that a function computes from each whole series in order; a series must fit in a worker."""
    keys = list(partition_by)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` {t}" for n, t in schema_of.items()])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order_by), kind="stable")
        return group.assign(**fn(group))

    found = df.groupBy(*keys).applyInPandas(run, schema)
    # NaN comes back from pandas as null.
    return found.withColumns({n: F.coalesce(F.col(n), F.lit(float("nan"))) for n, t in schema_of.items() if t == "double"})


def _alpha(alpha: float) -> float:
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    return alpha


#: What a series has gathered up to a row: weighted means of x and y, and their weighted variances and covariance.
State = tuple[float, float, float, float, float]


def _ewm(x: np.ndarray, alpha: float, y: float | None) -> np.ndarray:
    """y[t] = alpha x[t] + (1 - alpha) y[t - 1], from the given y before the first, or from x[0] itself."""
    out = np.empty(len(x))
    for t, v in enumerate(x.tolist()):
        y = v if y is None else alpha * v + (1 - alpha) * y
        out[t] = y
    return out


def _scanned(x: np.ndarray, y: np.ndarray, alpha: float, state: State | None, lagged: bool) -> dict[str, np.ndarray]:
    """Weighted means, variances and covariance after each row; without a state the first row starts the series.

    Products are of residuals about the current weighted means, with ``lagged`` about
    the preceding ones for the covariance.
    """
    mx, my, vx, vy, cov = state or (None, None, 0.0, 0.0, 0.0)
    means = _ewm(x, alpha, mx), _ewm(y, alpha, my)
    rx, ry = x - means[0], y - means[1]
    found = {"mean": means[0], "mean_y": means[1], "var": _ewm(rx * rx, alpha, vx), "var_y": _ewm(ry * ry, alpha, vy)}
    if lagged:
        rx, ry = (v - np.concatenate(([v[0] if start is None else start], m[:-1])) for v, m, start in zip((x, y), means, (mx, my), strict=True))
    found["cov"] = _ewm(rx * ry, alpha, cov)
    return found


_FIELDS = ("mean", "mean_y", "var", "var_y", "cov")


def _carried(parts: DataFrame, ends: Callable, alpha: float) -> dict[int, State]:
    """The state before each range but the first, from two passes that leave one row a range: means, then products about them."""
    schema = f"`{PART}` int, n long, first_x double, first_y double, " + ", ".join(f"{f} double" for f in _FIELDS)

    def folded(states: dict[int, State], fields: Sequence[int]) -> dict[int, State]:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            return ends(group, states)

        found = sorted(parts.groupBy(PART).applyInPandas(run, schema).collect(), key=lambda r: r[PART])  # one row a range
        out, now = {}, None
        for r in found:
            if now is None:
                now = [r["first_x"], r["first_y"], 0.0, 0.0, 0.0]
            out[r[PART]] = tuple(states.get(r[PART], now)[k] if k not in fields else now[k] for k in range(5))
            left = (1 - alpha) ** r["n"]
            for k in fields:
                now[k] = r[_FIELDS[k]] + left * now[k]
        return out

    return folded(folded({}, (0, 1)), (2, 3, 4))


def _weighted(df: DataFrame, x: str, y: str, alpha: float, order_by: Sequence[str], partition_by: Sequence[str], out: str, of: Callable, lagged: bool = False) -> DataFrame:
    """Adds ``of`` (what was scanned, whether the first row starts the series).

    With ``partition_by`` each series is one group.  A single series is cut into ranges
    of its order: a range's effect on the state is linear, so each is scanned for itself
    and one row a range carries the state to the next.
    """
    keys, by = list(partition_by), list(order_by)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` double"])
    of_group = lambda g, state: _scanned(g[x].to_numpy(dtype=float), g[y].to_numpy(dtype=float), alpha, state, lagged)

    def ordered(group: pd.DataFrame) -> pd.DataFrame:
        return group.sort_values(by, kind="stable", na_position="first")

    if keys:

        def whole(group: pd.DataFrame) -> pd.DataFrame:
            group = ordered(group)
            return group.assign(**{out: of(of_group(group, None), True)})

        found = df.groupBy(*keys).applyInPandas(whole, schema)
    else:
        parts = ranged(df, order_by)

        def ends(group: pd.DataFrame, states: dict[int, State]) -> pd.DataFrame:
            # From nothing in the first pass; in the second the means are known and products begin at 0.
            group = ordered(group)
            part = int(group[PART].iat[0])
            known = states.get(part)
            state = (0.0,) * 5 if known is None else (known[0], known[1], 0.0, 0.0, 0.0)
            last = {k: v[-1] for k, v in of_group(group, state).items()}
            return pd.DataFrame({PART: [part], "n": [len(group)], "first_x": [float(group[x].iat[0])], "first_y": [float(group[y].iat[0])], **{k: [last[k]] for k in _FIELDS}})

        states = _carried(parts, ends, alpha)
        start = min(states, default=0)

        def ranges(group: pd.DataFrame) -> pd.DataFrame:
            group = ordered(group)
            part = int(group[PART].iat[0])
            return group.drop(columns=PART).assign(**{out: of(of_group(group, None if part == start else states[part]), part == start)})

        found = parts.groupBy(PART).applyInPandas(ranges, schema)
    # NaN comes back from pandas as null.
    return found.withColumn(out, F.coalesce(out, F.lit(float("nan"))))


def _without_first(values: np.ndarray, starts: bool) -> np.ndarray:
    return np.where(starts & (np.arange(len(values)) == 0), np.nan, values)


def ewm_mean(df: DataFrame, value: str, alpha: float, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "ewm_mean") -> DataFrame:
    return _weighted(filter_missing(df, value), value, value, _alpha(alpha), order_by, partition_by, out, lambda s, starts: s["mean"])


def ewm_var(df: DataFrame, value: str, alpha: float, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "ewm_var") -> DataFrame:
    return _weighted(filter_missing(df, value), value, value, _alpha(alpha), order_by, partition_by, out, lambda s, starts: s["var"])


def ewm_cov(
    df: DataFrame, x: str, y: str, alpha: float, order_by: Sequence[str], partition_by: Sequence[str] = (), lagged_mean: bool = False, out: str = "ewm_cov"
) -> DataFrame:
    """Rows where either value is missing are left out of both; NaN for the first row."""
    rows = filter_missing(filter_missing(df, x), y)
    return _weighted(rows, x, y, _alpha(alpha), order_by, partition_by, out, lambda s, starts: _without_first(s["cov"], starts), lagged_mean)


def ewm_corr(df: DataFrame, x: str, y: str, alpha: float, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "ewm_corr") -> DataFrame:
    """Covariance over the root of both variances; NaN for the first row and where a variance is 0."""

    def corr(s: dict[str, np.ndarray], starts: bool) -> np.ndarray:
        under = np.sqrt(s["var"] * s["var_y"])
        return _without_first(np.where(under > 0, s["cov"] / np.where(under > 0, under, 1), np.nan), starts)

    return _weighted(filter_missing(filter_missing(df, x), y), x, y, _alpha(alpha), order_by, partition_by, out, corr)

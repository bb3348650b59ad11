import math

import numpy as np
import pytest

from sparkloom.operators import windows as w

NAN = float("nan")


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def near(found, want):
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=1e-6)


@pytest.fixture
def five(spark):
    return spark.createDataFrame([(i, i + 1, (3, 1, 4, 2, 5)[i]) for i in range(5)], "i int, a long, b long")


def test_rolling(five):
    near(column(w.rolling_sum(five, "a", 3, ["i"]), "rolling_sum"), [NAN, NAN, 6, 9, 12])
    near(column(w.rolling_mean(five, "a", 2, ["i"]), "rolling_mean"), [NAN, 1.5, 2.5, 3.5, 4.5])
    near(column(w.rolling_std(five, "a", 2, ["i"]), "rolling_std"), [NAN, 0.5, 0.5, 0.5, 0.5])
    near(column(w.rolling_apply(five, "a", 3, max, ["i"]), "rolling_apply"), [NAN, NAN, 3, 4, 5])
    near(column(w.rolling_apply(five, "a", 3, "max", ["i"]), "rolling_apply"), [NAN, NAN, 3, 4, 5])
    near(column(w.rolling_mad(five, "a", 3, ["i"]), "a_rollingMAD"), [NAN, NAN, 1, 1, 1])
    with pytest.raises(ValueError):
        w.rolling_sum(five, "a", 0, ["i"])


def test_rolling_mad_skips_gaps_inside(spark):
    df = spark.createDataFrame([(0, 1.0), (1, NAN), (2, 5.0), (3, None), (4, None)], "i int, a double")
    near(column(w.rolling_mad(df, "a", 2, ["i"]), "a_rollingMAD"), [NAN, 0.0, 0.0, 0.0, NAN])


def test_expanding(five):
    near(column(w.expanding_min(five, "b", ["i"]), "expanding_min"), [3, 1, 1, 1, 1])
    near(column(w.expanding_max(five, "b", ["i"]), "expanding_max"), [3, 3, 4, 4, 5])
    near(column(w.expanding_mean(five, "b", ["i"]), "expanding_mean"), [3, 2, 8 / 3, 2.5, 3])
    near(column(w.expanding_var(five, "a", ["i"]), "expanding_var"), [NAN, 0.5, 1, 5 / 3, 2.5])
    near(column(w.expanding_var(five, "a", ["i"], ddof=0), "expanding_var"), [0, 0.25, 2 / 3, 1.25, 2])


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_blocks_give_what_one_window_gives(spark, keys):
    from sparkloom.plans import sliding
    from pyspark.sql import functions as F

    df = spark.range(500).selectExpr("id as i", "1 as k", "cast((id * 37) % 101 as double) as v").repartition(7)
    found = sliding(df, ["i"], 9, 3, lambda f: {"s": F.sum("v").over(f), "n": F.count(F.lit(1)).over(f)}, keys, block=40)
    v = [(i * 37) % 101 for i in range(500)]
    assert column(found, "s") == [float(sum(v[max(0, i - 9) : i + 4])) for i in range(500)]
    near(column(w.expanding_mean(df, "v", ["i"], keys), "expanding_mean"), np.cumsum(v) / np.arange(1, 501))
    assert column(w.expanding_max(df, "v", ["i"], keys), "expanding_max") == list(np.maximum.accumulate(v))


def test_exponential(spark):
    x, y, a = [1.0, 2.0, 4.0, 3.0], [2.0, 1.0, 0.0, 5.0], 0.5
    df = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(zip(x, y, strict=True))], "i int, x double, y double")
    near(column(w.ewm_mean(df, "x", a, ["i"]), "ewm_mean"), [1, 1.5, 2.75, 2.875])
    mx, my, var, cov, vy = x[0], y[0], [0.0], [NAN], [0.0]
    c = 0.0
    for p, q in zip(x[1:], y[1:], strict=True):
        mx, my = a * p + (1 - a) * mx, a * q + (1 - a) * my
        var.append(a * (p - mx) ** 2 + (1 - a) * var[-1])
        vy.append(a * (q - my) ** 2 + (1 - a) * vy[-1])
        c = a * (p - mx) * (q - my) + (1 - a) * c
        cov.append(c)
    near(column(w.ewm_var(df, "x", a, ["i"]), "ewm_var"), var)
    near(column(w.ewm_cov(df, "x", "y", a, ["i"]), "ewm_cov"), cov)
    near(column(w.ewm_corr(df, "x", "y", a, ["i"]), "ewm_corr"), [NAN] + [k / math.sqrt(p * q) for k, p, q in zip(cov[1:], var[1:], vy[1:], strict=True)])
    near(column(w.ewm_cov(df, "x", "y", a, ["i"], lagged_mean=True), "ewm_cov")[:2], [NAN, a * (2.0 - 1.0) * (1.0 - 2.0)])
    with pytest.raises(ValueError):
        w.ewm_mean(df, "x", 0.0, ["i"])


def test_weighted_series_over_many_ranges(spark):
    """One long series without keys is scanned in ranges; the same rows under one key are scanned whole."""
    rng = np.random.default_rng(3)
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(5, 2, (500, 2)))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k int, i long, x double, y double").repartition(8)
        for fn, names in ((w.ewm_mean, ["x"]), (w.ewm_var, ["x"]), (w.ewm_cov, ["x", "y"]), (w.ewm_corr, ["x", "y"])):
            out = fn.__name__
            many = [r[out] for r in fn(df, *names, 0.1, ["i"]).orderBy("i").collect()]
            whole = [r[out] for r in fn(df, *names, 0.1, ["i"], ["k"]).orderBy("i").collect()]
            assert len(many) == 500 and np.allclose(many, whole, equal_nan=True)
        lagged = [r["c"] for r in w.ewm_cov(df, "x", "y", 0.1, ["i"], lagged_mean=True, out="c").orderBy("i").collect()]
        assert np.allclose(lagged, [r["c"] for r in w.ewm_cov(df, "x", "y", 0.1, ["i"], ["k"], lagged_mean=True, out="c").orderBy("i").collect()], equal_nan=True)
        assert w.ewm_mean(df.filter("i < 0"), "x", 0.1, ["i"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

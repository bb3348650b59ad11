import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import outliers as o
from sparkloom.operators import signal as s
from sparkloom.operators import timeseries as t
from sparkloom.operators import weighted as w

NAN = float("nan")


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def near(found, want, within=1e-6):
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=within), (found, want)


def numbered(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")


def at(hour, minute=0):
    return dt.datetime(2025, 1, 1, hour, minute)


def test_resample(spark):
    df = spark.createDataFrame([(at(0), 10.0), (at(1), 20.0), (at(3), 40.0)], "t timestamp_ntz, v double")
    found = t.resample(df, "t", "v", 3600)
    assert [tuple(r) for r in found.orderBy("t").collect()] == [(at(0), 10.0), (at(1), 20.0), (at(2), 30.0), (at(3), 40.0)]
    near(column(t.resample(df, "t", "v", 3600, interpolation="none"), "v", "t"), [10, 20, NAN, 40])
    near(column(t.resample(df, "t", "v", 7200, "sum"), "v", "t"), [30, 40])
    keyed = df.selectExpr("'a' as k", "t", "v").union(df.selectExpr("'b'", "t", "v + 1"))
    assert [(r["k"], r["v"]) for r in t.resample(keyed, "t", "v", 3600, partition_by=["k"]).orderBy("k", "t").collect()] == [("a", 10.0), ("a", 20.0), ("a", 30.0), ("a", 40.0), ("b", 11.0), ("b", 21.0), ("b", 31.0), ("b", 41.0)]


def test_resample_starts_off_the_grid(spark):
    df = spark.createDataFrame([(at(0), 0.0), (at(0, 50), 5.0), (at(3, 20), 20.0)], "t timestamp_ntz, v double")
    # 1:00 lies 10 of 150 minutes after 0:50, 2:00 lies 70 and 3:00 holds the last row.
    near(column(t.resample(df, "t", "v", 3600), "v", "t"), [2.5, 6.0, 12.0, 20.0])


def test_correlations(spark):
    df = numbered(spark, [1.0, 2.0, 3.0, 4.0])
    near(t.autocorrelation(df, "v", 3, ["i"]), [1, 1 / 3, -0.6, -1.8])
    near(t.partial_autocorrelation(df, "v", 3, ["i"]), [1, 0.25, -0.386667, -0.312709])
    assert t.partial_autocorrelation(df, "v", 0, ["i"]) == [1.0]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_decompose(spark, keys):
    df = numbered(spark, [1.0, 3.0, 1.0, 3.0, 1.0, 3.0]).selectExpr("*", "1 as k")
    found = t.seasonal_decompose(df, "v", 2, ["i"], keys)
    near(column(found, "trend"), [NAN, 2, 2, 2, 2, 2])
    near(column(found, "seasonal"), [-1, 1, -1, 1, -1, 1])
    near(column(found, "residual"), [NAN, 0, 0, 0, 0, 0])


def test_smoothing(spark):
    near(column(t.exponential_smoothing(numbered(spark, [1.0, 2.0, 3.0]), "v", 1, ["i"]), "level"), [1, 1.5, 2.25])
    holt = t.exponential_smoothing(numbered(spark, [3.0, 5.0, 9.0, 12.0]), "v", 1, ["i"], method="holt")
    near(column(holt, "level"), [3, 5, 8, 11.25])
    near(column(holt, "trend"), [2, 2, 2.5, 2.875])
    near(column(holt, "fitted"), [3, 7, 10.5, 14.125])
    hw = t.exponential_smoothing(numbered(spark, [10.0, 12.0, 11.0, 13.0]), "v", 2, ["i"], method="hw")
    near(column(hw, "level"), [NAN, 11, 11.75, 12.1875])
    near(column(hw, "trend"), [NAN, 0.5, 0.625, 0.53125])
    near(column(hw, "seasonal"), [-1, 1, -0.75, 0.8125])
    near(column(hw, "fitted"), [10, 12, 11.375, 13.71875])
    times = t.exponential_smoothing(numbered(spark, [10.0, 20.0, 10.0, 20.0]), "v", 2, ["i"], method="hw", seasonal="multiplicative")
    near(column(times, "fitted"), [10, 20, 10, 20])
    with pytest.raises(ValueError):
        t.exponential_smoothing(numbered(spark, [1.0]), "v", 1, ["i"], method="other")


def test_interpolate(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 9.0), (3, 16.0)], "i int, v double")
    near(column(t.interpolate(df, "i", "v", degree=2, precision=2), "v"), [1, 4, 9, 16])
    near(column(t.interpolate(df, "i", "v", method="spline", degree=2, precision=2), "v"), [1, 4.25, 9, 16])
    line = spark.createDataFrame([(0, 10.0), (50, NAN), (100, 30.0)], "i int, v double")
    near(column(t.interpolate(line, "i", "v", method="time"), "v"), [10, 20, 30])
    near(column(t.interpolate(line, "i", "v", method="linear"), "v"), [10, 20, 30])


def test_interpolants_pass_through_their_points():
    xs, ys = [0.0, 1.0, 3.0, 4.0], [1.0, 2.0, -1.0, 0.5]
    for f in (t.lagrange_at, t.spline_at, t.linear_at):
        near([f(x, xs, ys) for x in xs], ys)
    assert t.linear_at(5.0, xs, ys) == pytest.approx(2.0)
    assert t.spline_at(1.0, [0.0, 2.0, 3.0], [1.0, 9.0, 16.0]) == pytest.approx(4.25)
    with pytest.raises(ValueError):
        t.linear_at(0.0, [1.0], [1.0])


def test_weighted(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (4.0, 1.0), (9.0, 0.0), (None, 1.0)], "v double, w double")
    near([r["value"] for r in w.weighted_quantile(df, "v", "w", [0, 0.25, 0.5, 0.75, 1]).orderBy("q").collect()], [1, 1, 2, 3, 4])
    heavy = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 1.0)], "v double, w double")
    near([r["value"] for r in w.weighted_quantile(heavy, "v", "w").collect()], [2])
    assert math.isnan(w.weighted_quantile(heavy.limit(0), "v", "w").first()["value"])
    bars = spark.createDataFrame([(i, i) for i in range(1, 5)], "v long, w long")
    assert [tuple(r) for r in w.weighted_histogram(bars, "v", "w", 3).orderBy("binStart").collect()] == [(1.0, 2.0, 1.0), (2.0, 3.0, 2.0), (3.0, 4.0, 7.0)]
    assert w.weighted_histogram(bars, "v", "w").agg({"weight": "sum"}).first()[0] == 10
    assert w.weighted_histogram(bars.filter("v = 1"), "v", "w").count() == 1
    assert w.weighted_histogram(bars.limit(0), "v", "w").count() == 0


def test_outliers(spark):
    df = numbered(spark, [1, 2, 3, 4, 100], "long")
    assert column(o.outlier_iqr(df, "v"), "v_outlierIQR") == [False] * 5
    assert column(o.outlier_iqr(df, "v", 0.5), "v_outlierIQR") == [False] * 4 + [True]
    zeros = numbered(spark, [0, 0, 0, 0, 10], "long")
    assert column(o.outlier_zscore(zeros, "v"), "v_outlierZ") == [False] * 5
    assert column(o.outlier_zscore(zeros, "v", 1.5), "v_outlierZ") == [False] * 4 + [True]
    one = numbered(spark, [None, 3.0])
    assert column(o.outlier_iqr(one, "v"), "v_outlierIQR") == [False, False]
    assert column(o.outlier_zscore(one, "v"), "v_outlierZ") == [False, False]


def test_knn_and_lof(spark):
    df = spark.createDataFrame([(1.0, 4.0, 10.0), (2.0, 3.0, NAN), (3.0, 2.0, 30.0), (4.0, 1.0, None)], "F1 double, F2 double, T1 double")
    assert column(o.knn_impute(df, ["F1", "F2"], ["T1"], 2), "T1", "F1") == [10, 20, 30, 20]
    with pytest.raises(ValueError):
        o.knn_impute(df, ["F1"], ["T1"], 2, max_pairs=1)
    near(column(o.local_outlier_factor(numbered(spark, [1, 2, 3, 4, 5], "long"), ["v"], 2), "lof"), [1.306, 1.044, 0.833, 1.044, 1.306], 1e-3)
    far = column(o.local_outlier_factor(numbered(spark, [1.0, 2.0, 3.0, 100.0, None]), ["v"], 2), "lof")
    assert far[3] > 5 and math.isnan(far[4])
    with pytest.raises(ValueError):
        o.local_outlier_factor(df, ["F1"], 2, max_rows=2)


def test_signal(spark):
    df = spark.createDataFrame([(0, 1, 1, 4), (1, 2, 2, 5), (2, 3, 3, 6)], "i int, x long, y long, z long")
    assert column(s.convolve(df, "x", "y", ["i"]), "conv") == [1, 4, 10, 12, 9]
    found = s.cross_correlate(df, "x", "z", ["i"])
    assert column(found, "lag", "lag") == [-2, -1, 0, 1, 2] and column(found, "xcorr", "lag") == [12, 23, 32, 17, 6]
    rng = np.random.default_rng(0).normal(size=(700, 2))
    wide = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng)], "i int, x double, y double")
    near(column(s.convolve(wide, "x", "y", ["i"]), "conv"), np.convolve(rng[:, 0], rng[:, 1]))
    near(column(s.cross_correlate(wide, "x", "y", ["i"]), "xcorr", "lag"), np.correlate(rng[:, 1], rng[:, 0], "full"))
    times = spark.createDataFrame([(dt.datetime(2025, 1, 1, 0, 0, k), 1) for k in range(2)], "t timestamp_ntz, v long")
    found = s.fft(times, "t", "v").orderBy("frequency").collect()
    assert [tuple(r) for r in found] == [(0.0, 2.0, 0.0), (0.5, 0.0, 0.0)]
    assert s.fft(times.limit(1), "t", "v").count() == 0
    with pytest.raises(ValueError):
        s.convolve(df, "x", "y", ["i"], max_rows=2)


def brute_lof(points, k):
    """LOF by all distances, as the reference has it; infinite where a neighbourhood has no extent."""
    dist = [[math.dist(a, b) for b in points] for a in points]
    reach = [sorted(d)[min(k, len(points) - 1)] for d in dist]
    near = [[j for j, x in enumerate(d) if x <= r] for d, r in zip(dist, reach, strict=True)]
    sums = [sum(max(reach[j], dist[i][j]) for j in n) for i, n in enumerate(near)]
    lrd = [len(n) / s if s else math.inf for n, s in zip(near, sums, strict=True)]
    return [NAN if lrd[i] == math.inf and any(lrd[j] == math.inf for j in n) else sum(lrd[j] for j in n) / len(n) / lrd[i] for i, n in enumerate(near)]


def test_lof_counts_equal_rows_and_needs_no_limit(spark):
    v = [(i * i * 7919 % 1009) / 100 for i in range(150)] + [3.25] * 9 + [1e17, 1e17 + 64, 0.0, -0.0] + [50.0 + i for i in range(12)]
    got = column(o.local_outlier_factor(numbered(spark, v), ["v"], 4), "lof")
    for x, y in zip(got, brute_lof([(x,) for x in v], 4), strict=True):
        assert x == pytest.approx(y, rel=1e-9, nan_ok=True)
    flat = [((i * 37 % 11) / 2, (i * 53 % 7) / 4) for i in range(90)] + [(2.0, 2.0)] * 6
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(flat)], "i long, p double, q double")
    got = [r["lof"] for r in o.local_outlier_factor(df, ["p", "q"], 3).orderBy("i").collect()]
    for x, y in zip(got, brute_lof(flat, 3), strict=True):
        assert x == pytest.approx(y, rel=1e-9, nan_ok=True)
    many = spark.range(50_001).select((F.col("id") * 7919 % 50_001).cast("double").alias("v"))
    lof = o.local_outlier_factor(many, ["v"], 5)
    assert lof.count() == 50_001 and lof.filter("abs(lof - 1) > 0.5").count() == 0


def test_knn_looks_up_equal_features_once(spark):
    rows = [(i, None if i % 11 == 0 else float(i * 7 % 5), None if i % 6 == 0 else float(i * 3 % 4), float(i) if i % 3 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, p double, q double, t double")

    def filled(r):
        def apart(o):
            return [(a - b) ** 2 for a, b in zip(r[1:3], o[1:3], strict=True) if a is not None and b is not None]

        some = sorted((math.sqrt(sum(d)), o[0], o[3]) for o in rows if o[3] is not None and (d := apart(o)))[:4]
        return r[3] if r[3] is not None else sum(x[2] for x in some) / len(some) if some else None

    assert column(o.knn_impute(df, ["p", "q"], ["t"], 4, "i"), "t") == [pytest.approx(f) if (f := filled(r)) is not None else None for r in rows]
    many = spark.range(100_000).select(F.col("id").alias("i"), (F.col("id") % 25).alias("p"), F.when(F.col("id") % 2 == 0, F.col("id")).cast("double").alias("t"))
    found = o.knn_impute(many, ["p"], ["t"], 5, "i")  # 2.5 billion pairs of rows
    assert found.count() == 100_000 and found.filter("t is null").count() == 0
    assert found.filter("i = 99999").first()["t"] == 124  # 24, 74, 124, 174, 224 are its kin

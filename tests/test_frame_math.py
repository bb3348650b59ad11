import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import group
from sparkloom.operators.frame import Frame

NAN = float("nan")


def near(found, want):
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=1e-4)


def test_groups(spark):
    f = Frame.from_rows(spark, [["B", 1.0], ["A", 2.0], ["B", 3.0], ["A", 4.0]], ["g", "v"])
    assert f.group_by("g", "v", aggregate="sum").values == [["B", 4.0], ["A", 6.0]]
    assert f.group_by("g", "v", transform="mean")["v_transformed"] == [2.0, 3.0, 2.0, 3.0]
    assert f.group_by("g", "v", filter="sum", keep=lambda c: c >= 4).values == [["B", 1.0], ["B", 3.0], ["A", 2.0], ["A", 4.0]]
    with pytest.raises(ValueError):
        f.group_by("g", "v")


def test_shapes(spark):
    f = Frame.from_rows(spark, [[2, 10, 100], [1, 20, 200]], ["id", "A", "B"])
    long = f.melt(["id"], ["B", "A"])
    assert long.values == [[2, "B", 100], [2, "A", 10], [1, "B", 200], [1, "A", 20]]
    assert long.unstack("id", "variable", "value").values == [[2, 100, 10], [1, 200, 20]]
    assert long.pivot_table("id", "variable", "value").values == [[1, 20.0, 200.0], [2, 10.0, 100.0]]


def test_numbers(spark):
    f = Frame.from_columns(spark, {"A": [1.0, 2.0, None, 4.0, NAN, 0.0], "B": [5, 0, 0, 8, 9, 10]})
    assert f.filter_nulls("A")["A"] == [1, 2, 4, 0] and f.filter_nulls("A", skip=False)["A"] == [1, 2, 0, 4, 0, 0]
    assert (f.count_nulls("A"), f.count_zeros("A"), f.count_zeros("B")) == (2, 1, 2)
    assert (f.sum("A"), f.mean("A"), f.max("A"), f.min("A")) == (7, 1.75, 4, 0)
    assert group.map_python(f.df, "c0", lambda x: x * 2).filter(F.col("c0").isNotNull()).count() == 4


def test_windows(spark):
    f = Frame.from_columns(spark, {"A": [1, 2, 3, 4, 5], "B": [3, 1, 4, 2, 5]})
    near(f.rolling_sum("A", 3)["rolling_sum"], [NAN, NAN, 6, 9, 12])
    near(f.rolling_mean("A", 2)["rolling_mean"], [NAN, 1.5, 2.5, 3.5, 4.5])
    near(f.rolling_std("A", 2)["rolling_std"], [NAN, 0.5, 0.5, 0.5, 0.5])
    near(f.rolling_apply("A", 3, max)["rolling_apply"], [NAN, NAN, 3, 4, 5])
    near(f.rolling_mad("A", 3)["A_rollingMAD"], [NAN, NAN, 1, 1, 1])
    near(f.expanding_min("B")["expanding_min"], [3, 1, 1, 1, 1])
    near(f.expanding_max("B")["expanding_max"], [3, 3, 4, 4, 5])
    near(f.expanding_mean("B")["expanding_mean"], [3, 2, 8 / 3, 2.5, 3])
    near(f.expanding_var("A")["expanding_var"], [NAN, 0.5, 1, 5 / 3, 2.5])
    near(f.ewm_mean("A", 0.5)["ewm_mean"], [1, 1.5, 2.25, 3.125, 4.0625])
    assert f.ewm_var("A", 0.5)["ewm_var"][:2] == [0, 0.125] and math.isnan(f.ewm_cov("A", "B", 0.5)["ewm_cov"][0]) and len(f.ewm_corr("A", "B", 0.5)) == 5


def test_series(spark):
    times = [dt.datetime(2025, 1, 1, h) for h in (0, 1, 3)]
    f = Frame.from_rows(spark, [[10.0], [20.0], [40.0]], ["v"], times)
    hourly = f.resample("v", 3600)
    assert hourly["v"] == [10, 20, 30, 40] and hourly.index[2] == dt.datetime(2025, 1, 1, 2)
    g = Frame.from_columns(spark, {"A": [1.0, 2.0, 3.0, 4.0]})
    near(g.autocorrelation("A", 3), [1, 1 / 3, -0.6, -1.8])
    near(g.partial_autocorrelation("A", 3), [1, 0.25, -0.386667, -0.312709])
    near(Frame.from_columns(spark, {"A": [1, 3, 1, 3, 1, 3]}).seasonal_decompose("A", 2)["seasonal"], [-1, 1, -1, 1, -1, 1])
    near(Frame.from_columns(spark, {"v": [3, 5, 9, 12]}).exponential_smoothing("v", method="holt")["fitted"], [3, 7, 10.5, 14.125])
    near(Frame.from_columns(spark, {"v": [1.0, None, 9.0, 16.0]}).interpolate("v", degree=2, precision=2)["v"], [1, 4, 9, 16])
    assert len(f.fft("v").collect()) == 3


def test_rest(spark):
    f = Frame.from_rows(spark, [["A", 1, 1], ["A", 2, 2], ["A", 3, 3], ["B", 4, 4], ["B", 5, 5], ["B", 6, 100]], ["g", "v", "w"])
    assert f.anova("g", "v").f == pytest.approx(13.5) and f.t_test("g", "v").df == pytest.approx(4) and f.chi_square("g", "g").chi2 == pytest.approx(6)
    assert f.outlier_iqr("w", 0.5)["w_outlierIQR"][-1] and f.outlier_zscore("w", 2)["w_outlierZ"] == [False] * 5 + [True]
    near(f.local_outlier_factor(["v"], 2)["lof"][:1], [1.30556])
    gaps = Frame.from_columns(spark, {"x": [1.0, 2.0, 3.0], "t": [10.0, NAN, 30.0]})
    assert gaps.knn_impute(["x"], ["t"], 2)["t"] == [10, 20, 30]
    assert f.covariance_matrix(["v", "w"]).count() == 2 and f.bootstrap("v", n_boot=5).samples.count() == 5
    assert f.pca(["v", "w"]).loadings.shape == (2, 2) and f.svd(["v", "w"]).s.shape == (2,)
    assert f.convolve("v", "w").count() == 11 and f.cross_correlate("v", "w").count() == 11
    assert f.weighted_quantile("v", "w").count() == 1 and f.weighted_histogram("v", "w", 3).count() == 3

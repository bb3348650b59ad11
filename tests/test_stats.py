import numpy as np
import pytest

from sparkloom.functions import special
from sparkloom.operators import linalg, stats


def test_covariance(spark):
    df = spark.createDataFrame([(1.0, 2), (2.0, 4), (3.0, 6), (None, 7)], "X double, Y long")
    found = {r["column"]: (r["X"], r["Y"]) for r in stats.covariance_matrix(df, ["X", "Y"]).collect()}
    assert found["X"] == pytest.approx((2 / 3, 4 / 3)) and found["Y"] == pytest.approx((4 / 3, 8 / 3))


def test_tests(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", 2.0), ("B", 3.0), ("B", 4.0)], "g string, v double")
    t = stats.t_test(df, "g", "v")
    assert (t.t, t.df, t.p_value) == pytest.approx((-1.2247448, 4, 0.28786), abs=1e-5)
    far = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", 4.0), ("B", 5.0), ("B", 6.0)], "g string, v double")
    a = stats.anova(far, "g", "v")
    assert (a.f, a.df_between, a.df_within, a.eta_squared) == pytest.approx((13.5, 1, 4, 0.771429), abs=1e-5)
    assert a.p_value == pytest.approx(0.02131, abs=1e-5)
    with pytest.raises(ValueError):
        stats.t_test(far.filter("g = 'A'"), "g", "v")
    pairs = spark.createDataFrame([("A", "Yes"), ("A", "No"), ("B", "Yes"), ("B", "No")], "x string, y string")
    c = stats.chi_square(pairs, "x", "y")
    assert (c.chi2, c.dof, c.p_value) == pytest.approx((0, 1, 1))
    assert {r["n"] for r in c.observed.collect()} == {1} and {r["n"] for r in c.expected.collect()} == {1.0}


def test_bootstrap(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    b = stats.bootstrap(df, "x", "mean", 10)
    assert [r["sample"] for r in b.samples.collect()] == [5.0] * 10
    varied = stats.bootstrap(spark.range(100).selectExpr("cast(id as double) as x"), "x", "mean", 200)
    low, high = varied.percentile_ci(0.9)
    assert 40 < low < 49.5 < high < 59
    again = stats.bootstrap(spark.range(100).selectExpr("cast(id as double) as x"), "x", "mean", 200)
    assert sorted(varied.samples.collect()) == sorted(again.samples.collect())


def test_distributions():
    assert special.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_upper(420, 400) == pytest.approx(0.2366, abs=2e-3)
    assert special.t_two_sided(2.776445105, 4) == pytest.approx(0.05, abs=1e-9)
    assert special.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.beta_inc(2, 3, 0) == 0 and special.beta_inc(2, 3, 1) == 1 and special.gamma_upper(2, 0) == 1


@pytest.mark.parametrize(
    ("points", "first", "scores"),
    [
        ([(1, 1), (2, 2), (3, 3)], (0.70711, 0.70711), (-1.41421, 0, 1.41421)),
        ([(1, 2), (2, 4), (3, 6)], (0.44721, 0.89443), (-2.23607, 0, 2.23607)),
        ([(1, 4), (2, 3), (3, 2), (4, 1)], (0.70711, -0.70711), (-2.12132, -0.70711, 0.70711, 2.12132)),
    ],
)
def test_pca(spark, points, first, scores):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points], "X double, Y double")
    found = linalg.pca(df, ["X", "Y"])
    assert found.loadings[:, 0] == pytest.approx(first, abs=1e-4)
    assert sorted(r["PC1"] for r in found.scores.collect()) == pytest.approx(sorted(scores), abs=1e-4)


def test_pca_of_more_columns_is_orthonormal(spark):
    x = np.random.default_rng(1).normal(size=(60, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    found = linalg.pca(df, ["a", "b", "c", "d"], scale=True)
    assert found.loadings.T @ found.loadings == pytest.approx(np.eye(4), abs=1e-9)
    z = (x - x.mean(0)) / x.std(0)
    assert found.variances == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(z, rowvar=False)))[::-1])


def test_svd(spark):
    x = np.array([[1.0, 2.0], [3.0, 4.0], [0.0, 0.0]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "A double, B double").coalesce(1)
    found = linalg.svd(df, ["A", "B"])
    u = np.array([[r["U1"], r["U2"]] for r in found.u.collect()])
    assert u @ np.diag(found.s) @ found.vt == pytest.approx(x, abs=1e-8)
    assert found.s == pytest.approx(np.linalg.svd(x)[1])
    assert linalg.svd(spark.createDataFrame([(1.0, 0.0), (0.0, 1.0)], "A double, B double"), ["A", "B"]).s == pytest.approx([1, 1])
    assert linalg.transpose([[1, 2], [3, 4]]) == [[1, 3], [2, 4]] and linalg.dot([1, 2], [3, 4]) == 11
    assert linalg.covariance([[1, 2], [3, 4]]) == pytest.approx(np.full((2, 2), 2.0))
    assert linalg.singular_values([[1.0, 1.0], [1.0, 1.0], [1.0, 0.0]])[1] == pytest.approx(np.linalg.svd([[1.0, 1.0], [1.0, 1.0], [1.0, 0.0]])[1])
    assert linalg.eigen_decomposition([[2.0, 0.0], [0.0, 3.0]])[0].value == pytest.approx(3)

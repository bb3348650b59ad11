import numpy as np
import pytest

from sparkloom.llm.topk import Work, branch_and_bound, quantised, top_k_inner_products


def plain(vectors, k=5, every=50):
    """{(query id, rank): (id, score)} by looking at all."""
    out = {}
    for i, v in vectors:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in vectors if j != i)
            out |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("cells", [64, 100_000])
def test_random(spark, cells):
    x = np.random.default_rng(0).normal(size=(700, 24)) / 4
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    ints = np.floor(256 * x.astype(np.float32).astype(np.float64)).astype(int)
    want = plain([(i, v.tolist()) for i, v in enumerate(ints)])
    found = top_k_inner_products(df, cell_rows=cells, group_rows=7, block=5).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found} == want


def test_bounds_drop_nothing_that_counts():
    rng = np.random.default_rng(1)
    for spread in (0.1, 1.0, 4.0):
        q, c = np.floor(rng.normal(size=(20, 32)) * 100), np.floor(rng.normal(size=(500, 32)) * 100 * np.exp(rng.normal(size=(500, 1)) * spread))
        i, j, s = branch_and_bound(q, np.full(20, -1), c, np.arange(500), 5, block=4)
        full = q @ c.T
        for n in range(20):
            assert s[i == n].tolist() == sorted(full[n], reverse=True)[:5] and all(full[n, a] == b for a, b in zip(j[i == n], s[i == n], strict=True))


def test_bounds_drop_most_products_of_clustered_vectors():
    """Under half of all products are computed, and the answers are those of all."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 64))
    c = np.floor((centres[rng.integers(0, 20, size=4000)] + 0.3 * rng.normal(size=(4000, 64))) * 64)
    q, work = c[::50], Work()
    i, j, s = branch_and_bound(q, np.arange(0, 4000, 50), c, np.arange(4000), 5, work=work)
    full = q @ c.T
    full[np.arange(80), np.arange(0, 4000, 50)] = -np.inf
    for n in range(80):
        want = np.lexsort((np.arange(4000), -full[n]))[:5]
        assert j[i == n].tolist() == want.tolist() and s[i == n].tolist() == full[n, want].tolist()
    assert work.all == 80 * 4000 * 64 and work.done < work.all / 2


def test_whole_numbers_of_any_size(spark):
    assert quantised(np.array([[0.3, -0.001]])).tolist() == [[76.0, -1.0]]
    assert quantised(np.array([[1e17, 2e17, 0.3, 1e308]])).tolist() == [[256 * 10**17, 512 * 10**17, 76, 256 * int(1e308)]]
    df = spark.createDataFrame([(50, [2.0**-8, -(2.0**-8)]), (1, [1e17, 1e17]), (2, [2e17, 2e17 - 4096]), (3, [-1e300, 1e300])], "vec_id long, embedding array<double>")
    found = [(r["rank"], r["vec_id"], r["score"]) for r in top_k_inner_products(df).orderBy("rank").collect()]
    assert found == [(1, 2, 256 * 4096), (2, 1, 0), (3, 3, -(2**63))]


def test_ties_gaps_and_repeats(spark):
    rows = [
        (0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (5, None), (6, [float("nan"), 0.0]), (7, [None, 1.0]), (8, [float("inf"), 0.0]), (None, [1.0, 1.0]), (9, [1.0]), (50, []), (0, [1.0, 0.0]),
        (4, [3e18, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as score", "1 as cell", "2 as v")
    found = sorted(tuple(r) for r in top_k_inner_products(df, k=3).collect())
    assert found == [(0, 1, 4, 2**63 - 1), (0, 2, 2, 65536), (0, 3, 2, 65536)]
    assert top_k_inner_products(df.limit(0)).count() == 0

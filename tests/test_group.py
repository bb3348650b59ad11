import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import missing
from sparkloom.operators import group as g

NAN = float("nan")


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


@pytest.fixture
def letters(spark):
    return spark.createDataFrame([(0, "A", 1.0), (1, "B", 2.0), (2, "A", 3.0), (3, "B", 4.0)], "i int, g string, v double")


def test_aggregate_transform_filter(letters):
    assert rows(g.group_aggregate(letters, "g", "v", "sum", ["i"]), "g", "v") == [("A", 4.0), ("B", 6.0)]
    assert rows(g.group_transform(letters, "g", "v", "mean").orderBy("i"), "v_transformed") == [(2.0,), (3.0,), (2.0,), (3.0,)]
    assert rows(g.group_filter(letters, "g", "v", "sum", lambda c: c > 4).orderBy("i"), "g", "v") == [("B", 2.0), ("B", 4.0)]


def test_aggregate_by_function_skips_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", NAN), ("a", 3.0), ("b", None)], "g string, v double")
    assert dict(rows(g.group_aggregate(df, "g", "v", lambda x: max(x) - min(x)), "g", "v")) == {"a": 2.0, "b": None}
    with pytest.raises(ValueError):
        g.group_aggregate(df, "g", "v", "nothing")


@pytest.mark.parametrize(
    ("cells", "how", "want"),
    [
        ([("A", "x", 1.0), ("A", "x", 2.0), ("A", "y", 3.0), ("B", "x", 4.0), ("B", "y", 5.0)], "sum", [("A", 3.0, 3.0), ("B", 4.0, 5.0)]),
        ([("A", "x", 2.0), ("A", "x", 4.0), ("B", "x", 6.0), ("B", "y", 8.0), ("B", "y", 10.0)], "mean", [("A", 3.0, NAN), ("B", 6.0, 9.0)]),
        ([("A", "x", 1.0), ("B", "y", 2.0)], "sum", [("A", 1.0, NAN), ("B", NAN, 2.0)]),
    ],
)
def test_pivot(spark, cells, how, want):
    df = spark.createDataFrame(cells, "idx string, col string, val double")
    found = rows(g.pivot_table(df, "idx", "col", "val", how), "idx", "x", "y")
    assert [[c if not isinstance(c, float) or not math.isnan(c) else "gap" for c in r] for r in found] == [[c if not isinstance(c, float) or not math.isnan(c) else "gap" for c in r] for r in want]


def test_melt_and_back(spark):
    df = spark.createDataFrame([(1, 10, 100), (2, 20, 200)], "id long, A long, B long")
    long = g.melt(df, ["id"], ["A", "B"])
    assert sorted(rows(long, "id", "variable", "value")) == [(1, "A", 10), (1, "B", 100), (2, "A", 20), (2, "B", 200)]
    assert rows(g.unstack(long, "id", "variable", "value", ["id", "variable"]), "id", "A", "B") == [(1, 10, 100), (2, 20, 200)]
    with pytest.raises(ValueError):
        g.melt(df, [], ["A"])


def test_unstack_takes_the_first_and_leaves_gaps(spark):
    df = spark.createDataFrame([(0, "b", "q", 1), (1, "a", "p", 2), (2, "b", "q", 3)], "i int, k string, var string, v long")
    assert rows(g.unstack(df, "k", "var", "v", ["i"]), "k", "q", "p") == [("b", 1, None), ("a", None, 2)]


def test_missing(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 0), (None, 0), (4.0, 8), (NAN, 9), (0.0, 10)], "A double, B long")
    assert rows(missing.filter_missing(df, "A"), "A") == [(1.0,), (2.0,), (4.0,), (0.0,)]
    assert rows(missing.zero_filled(df, "A"), "A") == [(1.0,), (2.0,), (0.0,), (4.0,), (0.0,), (0.0,)]
    assert missing.count_missing(df).first().asDict() == {"A": 2, "B": 0}
    assert missing.count_zeros(df, "A").first()["n"] == 1
    assert missing.count_values(df, "B", [0, 9]).first()["n"] == 3
    assert g.column_stats(df, "A").first().asDict() == {"total": 7.0, "mean": 1.75, "smallest": 0.0, "largest": 4.0}
    assert g.column_stats(df.limit(0), "A").first()["total"] is None
    assert rows(g.map_column(df.limit(2), "B", lambda c: c * 2), "B") == [(10.0,), (0.0,)]
    assert rows(df.select(F.lit(1).alias("x")).limit(1), "x") == [(1,)]

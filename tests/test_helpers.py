import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import dt
from sparkloom.functions import helpers as h
from sparkloom.operators.frame import Frame


def test_equality():
    assert h.lists_equal([1, 2], [1, 2]) and not h.lists_equal([1, 2], [1])
    assert h.iterables_equal(iter([1, 2]), (1, 2)) and not h.iterables_equal([1, 2, 3], [1, 2]) and not h.iterables_equal([1], [1, None])
    assert h.iterables_equal_unordered([1, 2, 2], [2, 1, 2]) and not h.iterables_equal_unordered([1, 2], [1, 1, 2])
    assert h.sets_equal([1, 2, 2], [2, 1]) and h.count_contained([1, 2, 2, 3], [2, 9]) == 2


def test_chunks(spark):
    assert list(h.chunks(range(5), 2)) == [[0, 1], [2, 3], [4]]
    found = h.with_chunk(spark.range(10), ["id"], 4).groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in found] == [(0, 4), (1, 4), (2, 2)]
    with pytest.raises(ValueError):
        list(h.chunks([1], 0))


def test_weighted_quantile():
    assert h.weighted_quantile_of([1, 2, 3, 4], [1] * 4, [0, 0.25, 0.5, 0.75, 1]) == [1, 1, 2, 3, 4]
    assert h.weighted_quantile_of([1, 2, 3], [1, 3, 1], [0.5]) == [2] and math.isnan(h.weighted_quantile_of([], [], [0.5])[0])


def test_timedelta(spark):
    span = h.Timedelta(days=1, hours=2, minutes=3, seconds=4, nanoseconds=5)
    assert str(span) == "26:03:04.000000005" and span.total_microseconds == 93_784_000_000
    utc, tokyo = spark.range(1).select(dt.now(), dt.now("Asia/Tokyo")).first()
    assert (tokyo - utc).total_seconds() == 9 * 3600


def test_series(spark):
    s, t = h.Series([1, 2], ["a", "b"], "p"), h.Series([3, 4], ["b", "c"], "q")
    f = Frame.from_series(spark, [s, t])
    assert f.columns == ["p", "q"] and f.index == ["a", "b", "c"] and f["p"][:2] == [1.0, 2.0] and math.isnan(f["q"][0])
    more = Frame.from_rows(spark, [[1, 2]], ["a", "b"], ["first"]).append(h.Series([7, 8], ["a", "b"], "next"))
    assert more.values == [[1, 2], [7, 8]] and more.index == ["first", "next"]
    assert s.loc("b") == 2 and s.iloc(0) == 1 and len(s) == 2 and h.Series([1, 2], ["x", "x"]).loc("x") == [1, 2]
    with pytest.raises(KeyError):
        s.loc("z")
    with pytest.raises(ValueError):
        h.Series([1], ["a", "b"])
    assert f.df.filter(F.col("__ord") == 0).count() == 1

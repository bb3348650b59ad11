import os
import random
from itertools import accumulate
from urllib.parse import urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import group
from sparkloom.plans import running, running_extremes, shared_folder, with_ordinal, written

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_ordinals_follow_the_order(spark, parts):
    values = random.Random(0).sample(range(10_000), 300)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(parts)
    found = {r["v"]: r["__ord"] for r in with_ordinal(df, ["v"]).collect()}
    assert found == {v: i for i, v in enumerate(sorted(values))}
    down = {r["v"]: r["__ord"] for r in with_ordinal(df, [F.desc("v")]).collect()}
    assert down == {v: i for i, v in enumerate(sorted(values, reverse=True))}
    assert sorted(r["__ord"] for r in with_ordinal(df.select(F.lit(1).alias("v")), ["v"]).collect()) == list(range(300))
    assert with_ordinal(df.limit(0), ["v"]).count() == 0


@FEW
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.integers(1, 7))
def test_running(spark, values, parts):
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long").repartition(parts)
    both = running_extremes(running(df, ["i"], {"s": F.col("v")}), ["i"], {"lo": ("min", F.col("v")), "hi": ("max", F.col("v"))})
    rows = [(r["s"], r["lo"], r["hi"]) for r in both.orderBy("i").collect()]
    assert rows == list(zip(accumulate(values), accumulate(values, min), accumulate(values, max), strict=True))


@FEW
@given(st.dictionaries(st.tuples(st.integers(0, 5), st.sampled_from("abc")), st.integers(-9, 9), min_size=1))
def test_pivot_undoes_melt(spark, cells):
    long = spark.createDataFrame([(i, c, float(v)) for (i, c), v in cells.items()], "id long, c string, v double")
    wide = group.pivot_table(long, "id", "c", "v", "sum", ["a", "b", "c"])
    back = group.melt(wide, ["id"], ["a", "b", "c"], "c", "v").filter(~F.isnan("v"))
    assert {(r["id"], r["c"]): r["v"] for r in back.collect()} == cells


def test_written(spark):
    df = written(spark.range(10).withColumn("r", F.rand()), "test")
    assert df.collect() == df.collect() and df.count() == 10
    path = urlparse(df.inputFiles()[0]).path
    assert os.path.exists(path) and path.startswith(urlparse(shared_folder(spark)).path)

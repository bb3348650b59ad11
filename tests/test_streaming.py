import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import ewm_stream, resample_stream


@pytest.fixture
def events(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.filter("event_id % 2 = 0").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "in"))


def run(spark, df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_resample(spark, events):
    stream, rows = events
    found = run(spark, resample_stream(stream, "ts", "value", "1 day", "1 hour", "sum"), "by_day", "complete")
    want = rows.groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.sum("value").alias("value"))
    assert {r["ts"]: round(r["value"], 6) for r in found.collect()} == {r["ts"]: round(r["value"], 6) for r in want.collect()}


def test_ewm(spark, events):
    stream, rows = events
    found = run(spark, ewm_stream(stream, "user_id", "ts", "value", 0.5), "smooth", "append")
    user = rows.groupBy("user_id").count().orderBy(F.desc("count")).first()["user_id"]
    mean, want = None, []
    for r in rows.filter(F.col("user_id") == user).orderBy("ts").collect():
        mean = r["value"] if mean is None else 0.5 * r["value"] + 0.5 * mean
        want.append(mean)
    got = [r["ewm_mean"] for r in found.filter(F.col("user_id") == user).orderBy("ts").collect()]
    assert got == pytest.approx(want)

"""A query for every operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import dt, missing
from sparkloom.operators import group, linalg, outliers, signal, stats, timeseries, weighted, windows
from sparkloom.operators.frame import Frame, concat
from sparkloom.plans.stored import new_path
from sparkloom.sources import read_csv, to_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


#: Added before rounding where exact halves are common, as either engine may round those either way.
OFF_HALVES = 0.0000371


def off_halves(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + OFF_HALVES, digits) for n in names})


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """(day, i, v): the sum of the events' values of each day."""
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("v"))
    return days.withColumn("i", F.datediff("day", F.lit("2024-01-01")))


DAILY = "daily AS (SELECT CAST(ts AS DATE) AS day, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS i, round(sum(value), 2) AS v FROM events GROUP BY 1, 2)"

# Grouping


@query("SELECT l_returnflag, round(sum(l_quantity), 4) AS l_quantity FROM lineitem GROUP BY 1")
def group_aggregate_sum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(group.group_aggregate(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "sum"), "l_quantity")


@query("SELECT event_type, user_id, round(median(value), 4) AS value FROM events GROUP BY 1, 2")
def group_aggregate_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(group.group_aggregate(table(spark, sf, "events"), ["event_type", "user_id"], "value", "median"), "value")


@query("SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")
def group_aggregate_function(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(group.group_aggregate(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", lambda x: max(x) - min(x)), "o_totalprice")


@query(f"SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey) + {OFF_HALVES}, 4) AS o_totalprice_transformed FROM orders")
def group_transform_mean(spark: SparkSession, sf: str) -> DataFrame:
    found = group.group_transform(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "mean")
    return off_halves(found.select("o_orderkey", "o_totalprice_transformed"), "o_totalprice_transformed")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1000000)")
def group_filter_sum(spark: SparkSession, sf: str) -> DataFrame:
    return group.group_filter(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "sum", lambda c: c > 1_000_000).select("o_orderkey", "o_custkey")


@query("SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS smallest, max(o_totalprice) AS largest FROM orders")
def column_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(group.column_stats(table(spark, sf, "orders"), "o_totalprice"), "total", digits=2), "mean")


@query(
    "SELECT user_id, coalesce(sum(value) FILTER (event_type = 'click'), 'NaN'::DOUBLE).round(4) AS click, coalesce(sum(value) FILTER (event_type = 'purchase'), 'NaN'::DOUBLE).round(4) AS purchase FROM events GROUP BY 1"
)
def pivot_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(group.pivot_table(table(spark, sf, "events"), "user_id", "event_type", "value", "sum", ["click", "purchase"]), "click", "purchase")


@query("SELECT p_partkey, variable, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (value FOR variable IN (p_size, p_retailprice))")
def melt(spark: SparkSession, sf: str) -> DataFrame:
    return group.melt(table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("double")), ["p_partkey"], ["p_size", "p_retailprice"])


@query("SELECT l_orderkey, arg_min(l_quantity, [l_linenumber, l_partkey, l_suppkey, (l_extendedprice * 100)::BIGINT]) FILTER (l_returnflag = 'A') AS A, arg_min(l_quantity, [l_linenumber, l_partkey, l_suppkey, (l_extendedprice * 100)::BIGINT]) FILTER (l_returnflag = 'N') AS N, arg_min(l_quantity, [l_linenumber, l_partkey, l_suppkey, (l_extendedprice * 100)::BIGINT]) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1")
def unstack(spark: SparkSession, sf: str) -> DataFrame:
    return group.unstack(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["A", "N", "R"])


# Missing values


def gapped(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return items.withColumns({"l_discount": F.when(F.col("l_discount") != 0.05, F.col("l_discount")), "l_tax": F.when(F.col("l_tax") == 0.02, float("nan")).otherwise(F.col("l_tax"))})


@query("SELECT count(*) FILTER (l_discount = 0.05) AS l_discount, count(*) FILTER (l_tax = 0.02) AS l_tax FROM lineitem")
def count_missing(spark: SparkSession, sf: str) -> DataFrame:
    return missing.count_missing(gapped(spark, sf), "l_discount", "l_tax")


@query("SELECT count(*) FILTER (l_tax IN (0, 0.08)) AS n FROM lineitem")
def count_zeros(spark: SparkSession, sf: str) -> DataFrame:
    return missing.count_zeros(table(spark, sf, "lineitem"), "l_tax", [0.0, 0.08])


@query("SELECT count(*) FILTER (p_brand IN ('Brand#11', 'Brand#22')) AS n FROM part")
def count_values(spark: SparkSession, sf: str) -> DataFrame:
    return missing.count_values(table(spark, sf, "part"), "p_brand", ["Brand#11", "Brand#22"])


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_tax <> 0.02")
def filter_missing(spark: SparkSession, sf: str) -> DataFrame:
    return missing.filter_missing(gapped(spark, sf), "l_tax").select("l_orderkey", "l_linenumber", "l_tax")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0.05 THEN 0.0::DOUBLE ELSE l_discount END AS l_discount FROM lineitem")
def zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    return missing.zero_filled(gapped(spark, sf), "l_discount").select("l_orderkey", "l_linenumber", "l_discount")


# Labelled frames


def orders(spark: SparkSession, sf: str) -> Frame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return Frame.from_table(rows, ["o_orderkey"], index="o_orderkey")


def numbered(frame: Frame) -> DataFrame:
    """A frame as a table with its row numbers and labels."""
    return frame.df.select(F.col("__ord").alias("row"), F.col("__ix").alias("label"), *[F.col(n).alias(str(x)) for n, x in zip(frame.names, frame.labels, strict=True)])


ORDERS = "o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_orderkey AS label, o_custkey, o_totalprice, o_orderpriority FROM orders)"


@query(f"WITH {ORDERS} SELECT row, label, o_orderpriority, o_custkey FROM o")
def frame_select(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(orders(spark, sf).select("o_orderpriority", "o_custkey"))


@query(f"WITH {ORDERS} SELECT row, label, o_custkey * 2.0::DOUBLE AS o_custkey, o_totalprice, o_orderpriority FROM o")
def frame_map_column(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(orders(spark, sf).map_column("o_custkey", lambda c: c * 2))


@query(f"WITH {ORDERS} SELECT row, label, o_custkey, o_totalprice AS price FROM o")
def frame_drop_rename(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(orders(spark, sf).drop("o_orderpriority", axis=1).rename(columns={"o_totalprice": "price"}))


@query(f"WITH {ORDERS}, first AS (SELECT min(label) AS l FROM o) SELECT row - 1 AS row, label, o_custkey, o_totalprice, o_orderpriority FROM o WHERE label <> (SELECT l FROM first)")
def frame_drop_row(spark: SparkSession, sf: str) -> DataFrame:
    f = orders(spark, sf)
    return numbered(f.drop(f.df.agg(F.min("__ix")).first()[0]))


@query(f"WITH {ORDERS} SELECT row, label, o_custkey, o_totalprice, o_orderpriority FROM o WHERE row < 5")
def frame_head(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(orders(spark, sf).head())


@query(f"WITH {ORDERS} SELECT row, row AS label, o_custkey, o_totalprice, o_orderpriority FROM o")
def frame_reset_index(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(orders(spark, sf).reset_index())


@query(f"WITH {ORDERS} SELECT row_number() OVER (ORDER BY o_totalprice DESC, row) - 1 AS row, label, o_totalprice FROM o")
def frame_sort(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(orders(spark, sf).select("o_totalprice").sort("o_totalprice", ascending=False))


@query("SELECT row_number() OVER (ORDER BY upper(left(c_mktsegment, 1)), c_mktsegment, c_custkey) - 1 AS row, c_custkey AS label, c_mktsegment FROM customer")
def frame_sort_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return numbered(Frame.from_table(rows, ["c_custkey"], index="c_custkey").sort("c_mktsegment"))


@query("SELECT row_number() OVER (ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END NULLS FIRST, c_custkey) - 1 AS row, c_custkey AS label FROM customer")
def frame_sort_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, float("nan")).otherwise(F.col("c_acctbal")).alias("b"))
    return numbered(Frame.from_table(rows, ["c_custkey"], index="c_custkey").sort("b")).select("row", "label")


@query(f"WITH {ORDERS} SELECT row - 100 AS row, label, o_custkey, o_totalprice FROM o WHERE row BETWEEN 100 AND 149")
def frame_iloc_slice(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(orders(spark, sf).iloc[100:150, 0:2])


@query(f"WITH {ORDERS}, w(row, place) AS (VALUES (0, 7), (1, 3), (2, 11)) SELECT w.row::BIGINT AS row, label, o_custkey, o_totalprice, o_orderpriority FROM o JOIN w ON o.row = w.place")
def frame_iloc_gather(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(orders(spark, sf).iloc[[7, 3, 11]])


@query(f"WITH {ORDERS}, e AS (SELECT max(label) AS l FROM o) SELECT row, label, o_custkey, o_totalprice FROM o WHERE label < (SELECT l FROM e)")
def frame_loc_range(spark: SparkSession, sf: str) -> DataFrame:
    f = orders(spark, sf)
    first, last = f.df.agg(F.min("__ix"), F.max("__ix")).first()
    return numbered(f.loc({first: last}, {"o_custkey": "o_totalprice"}))


@query(f"WITH {ORDERS}, e AS (SELECT max(label) AS l FROM o) SELECT row, label, CASE WHEN label = (SELECT l FROM e) THEN 0.5 ELSE o_custkey::DOUBLE END AS o_custkey FROM o")
def frame_loc_edit(spark: SparkSession, sf: str) -> DataFrame:
    f = orders(spark, sf).select("o_custkey")
    return numbered(f.loc(f.df.agg(F.max("__ix")).first()[0], "o_custkey", edit=0.5))


@query(f"WITH {ORDERS}, e AS (SELECT max(row) AS r FROM o) SELECT CASE WHEN row = 0 THEN (SELECT r FROM e) ELSE row - 1 END AS row, label FROM o")
def frame_reindex_move(spark: SparkSession, sf: str) -> DataFrame:
    f = orders(spark, sf)
    first, last = f.df.agg(F.min("__ix"), F.max("__ix")).first()
    return numbered(f.reindex({first: last})).select("row", "label")


@query("SELECT n_nationkey AS label, row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS row, n_name FROM nation")
def frame_reindex_list(spark: SparkSession, sf: str) -> DataFrame:
    f = Frame.from_table(table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], index="n_nationkey")
    return numbered(f.reindex(f.index[::-1]))


def customers(spark: SparkSession, sf: str) -> Frame:
    return Frame.from_table(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal").toDF("key", "nation", "balance"), ["key"], index="key")


def suppliers(spark: SparkSession, sf: str) -> Frame:
    return Frame.from_table(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal").toDF("key", "name", "balance"), ["key"], index="key")


@query(
    "SELECT c_custkey AS label, c_nationkey::DOUBLE AS nation, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, 'NaN'::DOUBLE, s_acctbal, s_name FROM supplier"
)
def concat_rows_outer(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    return numbered(concat([c.with_column("nation", F.col(c.name("nation")).cast("long")), suppliers(spark, sf)])).drop("row")


@query("SELECT c_custkey AS label, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def concat_rows_inner(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(concat([customers(spark, sf), suppliers(spark, sf)], join="inner")).drop("row")


@query("SELECT c_custkey AS label, c_nationkey AS nation, c_acctbal AS balance, s_name AS name, s_acctbal AS other FROM customer JOIN supplier ON c_custkey = s_suppkey")
def concat_columns_inner(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(concat([customers(spark, sf), suppliers(spark, sf).rename(columns={"balance": "other"})], axis=1, join="inner")).drop("row")


@query("SELECT coalesce(c_custkey, s_suppkey) AS label, coalesce(c_acctbal, 'NaN'::DOUBLE) AS balance, s_name AS name, coalesce(s_acctbal, 'NaN'::DOUBLE) AS other FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def concat_columns_outer(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(concat([customers(spark, sf).select("balance"), suppliers(spark, sf).rename(columns={"balance": "other"})], axis=1)).drop("row")


@query("SELECT n_nationkey::BIGINT AS row, n_name FROM nation UNION ALL SELECT 25, 'ATLANTIS'")
def append_rows(spark: SparkSession, sf: str) -> DataFrame:
    f = Frame.from_table(table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], index="n_nationkey")
    return numbered(f.append([["ATLANTIS"]], ignore_index=True)).select("row", "n_name")


@query("SELECT 0 AS position, 'o_custkey' AS label, count(o_custkey) AS non_null, 'bigint' AS dtype FROM orders UNION ALL SELECT 1, 'o_totalprice', count(o_totalprice), 'double' FROM orders UNION ALL SELECT 2, 'o_orderpriority', count(o_orderpriority), 'string' FROM orders")
def frame_info(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).info()


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row, p_name, p_retailprice FROM part")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "csv")
    to_csv(Frame.from_table(table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), ["p_partkey"]).select("p_name", "p_retailprice"), path)
    return numbered(read_csv(spark, path)).drop("label")


# Windows, user by user

USERS = "PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN"


def _by_user(name: str, fn: Callable[..., DataFrame], **how: object) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
        return off_halves(fn(rows, "value", order_by=["ts", "event_id"], partition_by=["user_id"], **how).select("event_id", name), name)

    return run


for _name, _fn, _how, _expr in (
    ("rolling_sum", windows.rolling_sum, {"width": 5}, "sum(value)"),
    ("rolling_mean", windows.rolling_mean, {"width": 5}, "avg(value)"),
    ("rolling_std", windows.rolling_std, {"width": 5}, "stddev_pop(value)"),
    ("rolling_apply", windows.rolling_apply, {"width": 5, "how": lambda x: max(x) - min(x)}, "max(value) OVER w - min(value)"),
):
    QUERIES[_name] = _by_user(_name, _fn, **_how)
    SQL[_name] = f"SELECT event_id, CASE WHEN count(*) OVER w = 5 THEN round({_expr} OVER w + {OFF_HALVES}, 4) ELSE 'NaN'::DOUBLE END AS {_name} FROM events WINDOW w AS ({USERS} 4 PRECEDING AND CURRENT ROW)"

for _name, _fn, _how, _expr in (
    ("expanding_min", windows.expanding_min, {}, "min(value) OVER w"),
    ("expanding_max", windows.expanding_max, {}, "max(value) OVER w"),
    ("expanding_mean", windows.expanding_mean, {}, "avg(value) OVER w"),
    ("expanding_var", windows.expanding_var, {}, "coalesce(var_samp(value) OVER w, 'NaN'::DOUBLE)"),
):
    QUERIES[_name] = _by_user(_name, _fn, **_how)
    SQL[_name] = f"SELECT event_id, round({_expr} + {OFF_HALVES}, 4) AS {_name} FROM events WINDOW w AS ({USERS} UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    f"WITH f AS (SELECT event_id, count(*) OVER w AS n, list(value) OVER w AS l FROM events WINDOW w AS ({USERS} 4 PRECEDING AND CURRENT ROW)), m AS (SELECT event_id, n, l, list_aggregate(l, 'median') AS m FROM f) "
    "SELECT event_id, CASE WHEN n = 5 THEN round(list_aggregate(list_transform(l, lambda x: abs(x - m)), 'median'), 4) ELSE 'NaN'::DOUBLE END AS \"value_rollingMAD\" FROM m"
)
def rolling_mad(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return rounded(windows.rolling_mad(rows, "value", 5, ["ts", "event_id"], ["user_id"]).select("event_id", "value_rollingMAD"), "value_rollingMAD")


@query("SELECT i, CASE WHEN count(*) OVER w = 7 THEN round(avg(v) OVER w, 4) ELSE 'NaN'::DOUBLE END AS rolling_mean FROM daily WINDOW w AS (ORDER BY i ROWS 6 PRECEDING)".join([f"WITH {DAILY} ", ""]))
def rolling_mean_one_series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(windows.rolling_mean(daily(spark, sf).select(F.col("i").cast("long"), "v"), "v", 7, ["i"]).select("i", "rolling_mean"), "rolling_mean")


@query("SELECT l_orderkey, l_linenumber, round(sum(l_extendedprice) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) / row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey), 2) AS expanding_mean FROM lineitem")
def expanding_mean_one_series(spark: SparkSession, sf: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    found = windows.expanding_mean(table(spark, sf, "lineitem").select(*order, "l_extendedprice"), "l_extendedprice", order)
    return rounded(found.select("l_orderkey", "l_linenumber", "expanding_mean"), "expanding_mean", digits=2)


_NUMBERED = "n AS (SELECT event_id, user_id, value AS x, length(props)::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
_EWM = (
    f"WITH RECURSIVE {_NUMBERED}, r AS (SELECT event_id, user_id, k, x AS mx, y AS my, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 0.0::DOUBLE AS c FROM n WHERE k = 1 UNION ALL "
    "SELECT event_id, user_id, k, mx, my, 0.3 * (x - mx) * (x - mx) + 0.7 * vx, 0.3 * (y - my) * (y - my) + 0.7 * vy, 0.3 * (x - mx) * (y - my) + 0.7 * c FROM "
    "(SELECT n.event_id, n.user_id, n.k, n.x, n.y, 0.3 * n.x + 0.7 * r.mx AS mx, 0.3 * n.y + 0.7 * r.my AS my, r.vx, r.vy, r.c FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)) "
)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("value").alias("x"), F.char_length("props").cast("double").alias("y"))


@query(_EWM + "SELECT event_id, round(mx, 4) AS ewm_mean FROM r")
def ewm_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(windows.ewm_mean(_pairs(spark, sf), "x", 0.3, ["ts", "event_id"], ["user_id"]).select("event_id", "ewm_mean"), "ewm_mean")


@query(_EWM + "SELECT event_id, round(vx, 4) AS ewm_var FROM r")
def ewm_var(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(windows.ewm_var(_pairs(spark, sf), "x", 0.3, ["ts", "event_id"], ["user_id"]).select("event_id", "ewm_var"), "ewm_var")


@query(_EWM + "SELECT event_id, CASE WHEN k = 1 THEN 'NaN'::DOUBLE ELSE round(c, 4) END AS ewm_cov FROM r")
def ewm_cov(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(windows.ewm_cov(_pairs(spark, sf), "x", "y", 0.3, ["ts", "event_id"], ["user_id"]).select("event_id", "ewm_cov"), "ewm_cov")


@query(_EWM + "SELECT event_id, CASE WHEN k = 1 OR vx * vy = 0 THEN 'NaN'::DOUBLE ELSE round(c / sqrt(vx * vy), 4) END AS ewm_corr FROM r")
def ewm_corr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(windows.ewm_corr(_pairs(spark, sf), "x", "y", 0.3, ["ts", "event_id"], ["user_id"]).select("event_id", "ewm_corr"), "ewm_corr")


# Time series


@query(
    "WITH e AS (SELECT user_id, ts, event_id, value FROM events), b AS (SELECT user_id, min(ts) AS low, max(ts) AS high FROM e GROUP BY 1), "
    "g AS (SELECT user_id, low, unnest(generate_series(0, floor(epoch_us(high) / 86400000000 - epoch_us(low) / 86400000000)::BIGINT + 1)) AS s, high FROM b), "
    "grid AS (SELECT user_id, low, s, low + to_days(s::INTEGER) AS t FROM g WHERE low + to_days(s::INTEGER) <= high), "
    "a AS (SELECT e.user_id, (epoch_us(e.ts) - epoch_us(low)) // 86400000000 AS s, avg(value) AS v FROM e JOIN b USING (user_id) GROUP BY 1, 2), "
    "p AS (SELECT grid.user_id, s, arg_max(e.value, e.ts) AS v0, max(e.ts) AS t0 FROM grid JOIN e ON e.user_id = grid.user_id AND e.ts <= grid.t GROUP BY 1, 2), "
    "q AS (SELECT grid.user_id, s, arg_min(e.value, e.ts) AS v1, min(e.ts) AS t1 FROM grid JOIN e ON e.user_id = grid.user_id AND e.ts > grid.t GROUP BY 1, 2) "
    "SELECT grid.user_id, grid.t AS ts, round(coalesce(a.v, v0 + (v1 - v0) * (epoch_us(grid.t) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))), 4) AS value "
    "FROM grid LEFT JOIN a USING (user_id, s) LEFT JOIN p USING (user_id, s) LEFT JOIN q USING (user_id, s)"
)
def resample_mean_linear(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "ts", "value")
    return rounded(timeseries.resample(rows, "ts", "value", 86_400, "mean", partition_by=["user_id"]), "value")


@query(
    f"WITH {DAILY}, s AS (SELECT v - avg(v) OVER () AS x, row_number() OVER (ORDER BY i) AS k FROM daily), l AS (SELECT unnest(generate_series(0, 5)) AS lag), n AS (SELECT count(*) AS n, avg(x * x) AS var FROM s) "
    "SELECT lag::BIGINT AS lag, round(sum(a.x * b.x) / (any_value(n) - lag) / any_value(var), 6) AS acf FROM l, n, s a JOIN s b ON b.k = a.k + lag GROUP BY lag"
)
def autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    found = timeseries.autocorrelation(daily(spark, sf), "v", 5, ["i"])
    return rounded(spark.createDataFrame(list(enumerate(found)), "lag long, acf double"), "acf", digits=6)


@query(
    f"WITH RECURSIVE {DAILY}, s AS (SELECT v - avg(v) OVER () AS x, row_number() OVER (ORDER BY i) AS k FROM daily), l AS (SELECT unnest(generate_series(0, 5)) AS lag), "
    "c AS (SELECT lag, sum(a.x * b.x) AS s FROM l, s a JOIN s b ON b.k = a.k + lag GROUP BY lag), rho AS (SELECT list(s / (SELECT s FROM c WHERE lag = 0) ORDER BY lag) FILTER (lag > 0) AS r FROM c), "
    "d AS (SELECT 1 AS k, [r[1]] AS phi, r[1] AS new, 1 - r[1] * r[1] AS rest FROM rho UNION ALL "
    "SELECT k + 1, list_transform(list_zip(phi, list_reverse(phi)), lambda z: z[1] - step * z[2]) || [step], step, rest * (1 - step * step) FROM "
    "(SELECT k, phi, rest, (r[k + 1] - list_dot_product(phi, list_reverse(r[1:k]))) / rest AS step FROM d, rho WHERE k < 5)) "
    "SELECT 0::BIGINT AS lag, 1.0::DOUBLE AS pacf UNION ALL SELECT k, round(new, 6) FROM d"
)
def partial_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    found = timeseries.partial_autocorrelation(daily(spark, sf), "v", 5, ["i"])
    return rounded(spark.createDataFrame(list(enumerate(found)), "lag long, pacf double"), "pacf", digits=6)


@query(
    f"WITH {DAILY}, t AS (SELECT i, v, row_number() OVER (ORDER BY i) - 1 AS k, CASE WHEN count(*) OVER w = 7 THEN avg(v) OVER w END AS trend FROM daily WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), "
    "s AS (SELECT k % 7 AS p, avg(v - trend) AS seasonal FROM t GROUP BY 1) SELECT i, coalesce(round(trend, 4), 'NaN'::DOUBLE) AS trend, round(seasonal, 4) AS seasonal, coalesce(round(v - trend - seasonal, 4), 'NaN'::DOUBLE) AS residual FROM t JOIN s ON k % 7 = p"
)
def seasonal_decompose(spark: SparkSession, sf: str) -> DataFrame:
    found = timeseries.seasonal_decompose(daily(spark, sf).select(F.col("i").cast("long"), "v"), "v", 7, ["i"])
    return rounded(found.select("i", "trend", "seasonal", "residual"), "trend", "seasonal", "residual")


_STEPS = f"WITH RECURSIVE {DAILY}, n AS (SELECT i, v, row_number() OVER (ORDER BY i) - 1 AS k FROM daily), "


def _smooth(spark: SparkSession, sf: str, method: str, *names: str) -> DataFrame:
    found = timeseries.exponential_smoothing(daily(spark, sf).select(F.col("i").cast("long"), "v"), "v", 7, ["i"], method=method, alpha=0.4, beta=0.3, gamma=0.2)
    return rounded(found.select("i", *names), *names, digits=3)


@query(_STEPS + "r AS (SELECT i, k, v AS level FROM n WHERE k = 0 UNION ALL SELECT n.i, n.k, 0.4 * n.v + 0.6 * r.level FROM r JOIN n ON n.k = r.k + 1) SELECT i, round(level, 3) AS level, round(level, 3) AS fitted FROM r")
def smoothing_ses(spark: SparkSession, sf: str) -> DataFrame:
    return _smooth(spark, sf, "ses", "level", "fitted")


@query(
    _STEPS + "r AS (SELECT a.i, a.k, a.v AS level, b.v - a.v AS trend, a.v AS fitted FROM n a JOIN n b ON a.k = 0 AND b.k = 1 UNION ALL "
    "SELECT i, k, l, 0.3 * (l - pl) + 0.7 * pt, l + 0.3 * (l - pl) + 0.7 * pt FROM (SELECT n.i, n.k, r.level AS pl, r.trend AS pt, 0.4 * n.v + 0.6 * (r.level + r.trend) AS l FROM r JOIN n ON n.k = r.k + 1)) "
    "SELECT i, round(level, 3) AS level, round(trend, 3) AS trend, round(fitted, 3) AS fitted FROM r"
)
def smoothing_holt(spark: SparkSession, sf: str) -> DataFrame:
    return _smooth(spark, sf, "holt", "level", "trend", "fitted")


@query(
    _STEPS + "m AS (SELECT avg(v) FILTER (k < 7) AS one, avg(v) FILTER (k BETWEEN 7 AND 13) AS two FROM n), "
    "r AS (SELECT 6::BIGINT AS k, one AS level, (two - one) / 7 AS trend, (SELECT list(v - one ORDER BY k) FROM n WHERE k < 7) AS s, 0.0::DOUBLE AS fitted FROM m UNION ALL "
    "SELECT k, l, t, s[2:] || [0.2 * (v - base) + 0.8 * s[1]], l + t + s[1] FROM (SELECT k, v, l, base, s, 0.3 * (l - pl) + 0.7 * pt AS t FROM "
    "(SELECT n.k, n.v, r.s, r.level AS pl, r.trend AS pt, r.level + r.trend AS base, 0.4 * (n.v - r.s[1]) + 0.6 * (r.level + r.trend) AS l FROM r JOIN n ON n.k = r.k + 1))) "
    "SELECT n.i, CASE WHEN n.k < 6 THEN 'NaN'::DOUBLE ELSE round(level, 3) END AS level, round(CASE WHEN n.k < 7 THEN n.v ELSE fitted END, 3) AS fitted FROM n LEFT JOIN r USING (k)"
)
def smoothing_holt_winters(spark: SparkSession, sf: str) -> DataFrame:
    return _smooth(spark, sf, "hw", "level", "fitted")


def _holes(spark: SparkSession, sf: str) -> DataFrame:
    return daily(spark, sf).select(F.col("i").cast("long"), F.when(F.col("i") % 5 != 2, F.col("v")).alias("v"))


@query(
    f"WITH {DAILY}, h AS (SELECT i, CASE WHEN i % 5 <> 2 THEN v END AS v FROM daily), p AS (SELECT a.i, max(b.i) FILTER (b.i < a.i) AS lo, min(b.i) FILTER (b.i > a.i) AS hi FROM h a, h b WHERE b.v IS NOT NULL GROUP BY 1) "
    "SELECT h.i, round(coalesce(h.v, l.v + (u.v - l.v) * (h.i - l.i) / (u.i - l.i)), 4) AS v FROM h JOIN p USING (i) LEFT JOIN h l ON l.i = lo LEFT JOIN h u ON u.i = hi"
)
def interpolate_time(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.interpolate(_holes(spark, sf), "i", "v", method="time", degree=1), "v")


_NEAREST = (
    f"WITH {DAILY}, h AS (SELECT i, CASE WHEN i % 5 <> 2 THEN v END AS v FROM daily), "
    "near AS (SELECT g.i AS g, k.i AS x, k.v AS y FROM h g, h k WHERE g.v IS NULL AND k.v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g.i ORDER BY abs(k.i - g.i), k.i) <= 4), "
)


@query(
    _NEAREST + "p AS (SELECT g, list(x ORDER BY x) AS x, list(y ORDER BY x) AS y FROM near GROUP BY g), "
    "q AS (SELECT *, x[2] - x[1] AS h1, x[3] - x[2] AS h2, x[4] - x[3] AS h3, (y[3] - y[2]) / (x[3] - x[2]) AS s2 FROM p), "
    "r AS (SELECT *, 6 * (s2 - (y[2] - y[1]) / h1) AS e1, 6 * ((y[4] - y[3]) / h3 - s2) AS e2, 4 * (h1 + h2) * (h2 + h3) - h2 * h2 AS det FROM q), "
    "m AS (SELECT *, [0, (2 * (h2 + h3) * e1 - h2 * e2) / det, (2 * (h1 + h2) * e2 - h2 * e1) / det, 0] AS b, CASE WHEN x[1] < g AND g <= x[4] THEN len(list_filter(x, lambda z: z < g)) ELSE 1 END AS j FROM r), "
    "f AS (SELECT g, x[j + 1] - g AS u, g - x[j] AS w, x[j + 1] - x[j] AS d, b[j] AS b0, b[j + 1] AS b1, y[j] AS y0, y[j + 1] AS y1 FROM m) "
    "SELECT h.i, round(coalesce(h.v, (b0 * u ^ 3 + b1 * w ^ 3) / (6 * d) + (y0 / d - b0 * d / 6) * u + (y1 / d - b1 * d / 6) * w), 4) AS v FROM h LEFT JOIN f ON f.g = h.i"
)
def interpolate_spline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.interpolate(_holes(spark, sf), "i", "v", method="spline"), "v")


@query(
    _NEAREST + "w AS (SELECT a.g, a.x, any_value(a.y) * product((a.g - b.x) / (a.x - b.x)) AS part FROM near a JOIN near b ON a.g = b.g AND a.x <> b.x GROUP BY a.g, a.x), "
    "f AS (SELECT g, round(sum(part), 4) AS v FROM w GROUP BY g) SELECT h.i, coalesce(h.v, f.v) AS v FROM h LEFT JOIN f ON f.g = h.i"
)
def interpolate_polynomial(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.interpolate(_holes(spark, sf), "i", "v", precision=4)


# Weighted, outliers, statistics


@query(
    "WITH c AS (SELECT l_extendedprice AS v, sum(sum(l_quantity)) OVER (ORDER BY l_extendedprice) AS up, sum(sum(l_quantity)) OVER () AS total FROM lineitem GROUP BY 1), q AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS q) "
    "SELECT q, min(v) FILTER (up >= q * total) AS value FROM c, q GROUP BY 1"
)
def weighted_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return weighted.weighted_quantile(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", (0.25, 0.5, 0.75))


@query(
    "WITH r AS (SELECT min(l_extendedprice) AS low, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem), b AS (SELECT unnest(generate_series(0, 19)) AS id), "
    "s AS (SELECT least(floor((l_extendedprice - low) / w), 19)::BIGINT AS id, sum(l_quantity) AS weight FROM lineitem, r GROUP BY 1) "
    "SELECT round(low + id * w, 4) AS binStart, round(low + id * w + w, 4) AS binEnd, coalesce(weight, 0) AS weight FROM b LEFT JOIN s USING (id), r"
)
def weighted_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weighted.weighted_histogram(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", 20), "binStart", "binEnd")


@query(
    "WITH s AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders), "
    "q AS (SELECT median(x) FILTER (i < n // 2) AS a, median(x) FILTER (i >= n - n // 2) AS b FROM s) "
    'SELECT o_orderkey, (o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a)) AS "o_totalprice_outlierIQR" FROM orders, q'
)
def outlier_iqr(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.outlier_iqr(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.5).drop("o_totalprice")


@query('SELECT o_orderkey, abs((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()) > 1.5 AS "o_totalprice_outlierZ" FROM orders')
def outlier_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.outlier_zscore(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 1.5).drop("o_totalprice")


@query(
    "WITH s AS (SELECT s_suppkey AS id, s_nationkey::DOUBLE AS f, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS t FROM supplier), "
    "p AS (SELECT a.id, b.t, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.f - b.f), b.id) AS r FROM s a, s b WHERE a.t IS NULL AND b.t IS NOT NULL) "
    "SELECT s.id AS s_suppkey, round(coalesce(any_value(s.t), avg(p.t)), 4) AS t FROM s LEFT JOIN p ON p.id = s.id AND r <= 5 GROUP BY 1"
)
def knn_impute(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("t"))
    return rounded(outliers.knn_impute(rows, ["s_nationkey"], ["t"], 5, "s_suppkey").select("s_suppkey", "t"), "t")


@query(
    "WITH s AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier), d AS (SELECT a.id AS a, b.id AS b, abs(a.x - b.x) AS d FROM s a, s b), "
    "k AS (SELECT a, d AS kd FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) WHERE r = 6), n AS (SELECT d.* FROM d JOIN k USING (a) WHERE d <= kd), "
    "l AS (SELECT n.a, count(*) / sum(greatest(kd, d)) AS lrd FROM n JOIN k ON k.a = n.b GROUP BY 1) "
    "SELECT n.a AS s_suppkey, round(avg(o.lrd) / any_value(l.lrd), 4) AS lof FROM n JOIN l ON l.a = n.a JOIN l o ON o.a = n.b GROUP BY 1"
)
def local_outlier_factor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outliers.local_outlier_factor(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"], 5, "s_suppkey").select("s_suppkey", "lof"), "lof")


@query(
    "SELECT 'l_quantity' AS \"column\", round(covar_pop(l_quantity, l_quantity), 4) AS l_quantity, round(covar_pop(l_quantity, l_discount), 4) AS l_discount FROM lineitem UNION ALL "
    "SELECT 'l_discount', round(covar_pop(l_quantity, l_discount), 4), round(covar_pop(l_discount, l_discount), 4) FROM lineitem"
)
def covariance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.covariance_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]), "l_quantity", "l_discount")


@query(
    "WITH g AS (SELECT l_linestatus, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM g ORDER BY 1 LIMIT 1), b AS (SELECT * FROM g ORDER BY 1 DESC LIMIT 1) "
    "SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 3) AS df FROM a, b"
)
def t_test(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.t_test(table(spark, sf, "lineitem"), "l_linestatus", "l_quantity")
    return rounded(rounded(spark.createDataFrame([(found.t, found.df)], "t double, df double"), "t", digits=6), "df", digits=3)


@query(
    "WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), w AS (SELECT avg(o_totalprice) AS m FROM orders), "
    "s AS (SELECT sum(n * (g.m - w.m) * (g.m - w.m)) AS sb, sum((n - 1) * v) AS sw, count(*) - 1 AS d1, sum(n) - count(*) AS d2 FROM g, w) "
    "SELECT round((sb / d1) / (sw / d2), 6) AS f, d1::BIGINT AS df_between, d2::BIGINT AS df_within, round(sb / (sb + sw), 8) AS eta_squared FROM s"
)
def anova(spark: SparkSession, sf: str) -> DataFrame:
    a = stats.anova(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    found = spark.createDataFrame([(a.f, a.df_between, a.df_within, a.eta_squared)], "f double, df_between long, df_within long, eta_squared double")
    return rounded(rounded(found, "f", digits=6), "eta_squared", digits=8)


@query(
    "WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), a AS (SELECT x, sum(n) AS nx FROM c GROUP BY 1), b AS (SELECT y, sum(n) AS ny FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c) "
    "SELECT round(sum(pow(coalesce(n, 0) - nx * ny / t, 2) / (nx * ny / t)), 4) AS chi2, ((SELECT count(*) FROM a) - 1) * ((SELECT count(*) FROM b) - 1) AS dof FROM a CROSS JOIN b CROSS JOIN t LEFT JOIN c USING (x, y)"
)
def chi_square(spark: SparkSession, sf: str) -> DataFrame:
    c = stats.chi_square(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return rounded(spark.createDataFrame([(c.chi2, c.dof)], "chi2 double, dof long"), "chi2")


@query()
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return stats.bootstrap(daily(spark, sf), "v", "mean", 200, seed=1).samples


# Linear algebra and signals


@query()
def pca_scores(spark: SparkSession, sf: str) -> DataFrame:
    return linalg.pca(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], scale=True).scores


@query()
def svd_left_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return linalg.svd(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).u


@query(
    "WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, stddev_pop(l_quantity) AS sx, stddev_pop(l_extendedprice) AS sy, sign(covar_pop(l_quantity, l_extendedprice)) AS c FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL), "
    "z AS (SELECT (l_quantity - mx) / sx AS x, (l_extendedprice - my) / sy AS y, c FROM lineitem, m WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) "
    "SELECT round((x + c * y) / sqrt(2), 6) + 0.0 AS PC1, round((x - c * y) / sqrt(2), 6) + 0.0 AS PC2 FROM z"
)
def pca_two_columns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(linalg.pca(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], scale=True).scores, "PC1", "PC2", digits=6)


@query(
    "WITH t AS (SELECT l_discount AS x, l_tax AS y FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL), g AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS d FROM t), "
    "e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ^ 2 + b * b) AS l1, (a + d) / 2 - sqrt(((a - d) / 2) ^ 2 + b * b) AS l2 FROM g), "
    "n AS (SELECT *, sqrt((l1 - d) ^ 2 + b * b) AS n1, sqrt((d - l2) ^ 2 + b * b) AS n2 FROM e) "
    "SELECT round((x * (l1 - d) + y * b) / n1 / sqrt(l1), 8) AS U1, round((x * (d - l2) - y * b) / n2 / sqrt(l2), 8) AS U2 FROM t, n"
)
def svd_two_columns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(linalg.svd(table(spark, sf, "lineitem"), ["l_discount", "l_tax"]).u, "U1", "U2", digits=8)


_XY = f"WITH {DAILY}, s AS (SELECT v AS x, sqrt(v) AS y, row_number() OVER (ORDER BY i) - 1 AS k, count(*) OVER () AS n FROM daily) "


def _signal(spark: SparkSession, sf: str) -> DataFrame:
    return daily(spark, sf).select("day", "i", F.col("v").alias("x"), F.sqrt("v").alias("y"))


@query(_XY + "SELECT a.k + b.k AS i, round(sum(a.x * b.y), 2) AS conv FROM s a, s b GROUP BY 1")
def convolve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signal.convolve(_signal(spark, sf), "x", "y", ["i"]), "conv", digits=2)


@query(_XY + "SELECT b.k - a.k AS lag, round(sum(a.x * b.y), 2) AS xcorr FROM s a, s b GROUP BY 1")
def cross_correlate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signal.cross_correlate(_signal(spark, sf), "x", "y", ["i"]), "xcorr", digits=2)


@query(
    _XY + f"SELECT round(f.k / (any_value(f.n) * 86400.0), 12) AS frequency, round(sum(s.x * cos(2 * pi() * f.k * s.k / s.n)) + {OFF_HALVES}, 2) AS real, round({OFF_HALVES} - sum(s.x * sin(2 * pi() * f.k * s.k / s.n)), 2) AS imag FROM s f, s GROUP BY f.k"
)
def fft(spark: SparkSession, sf: str) -> DataFrame:
    found = signal.fft(_signal(spark, sf).withColumn("day", F.col("day").cast("timestamp_ntz")), "day", "x")
    return rounded(off_halves(found, "real", "imag", digits=2), "frequency", digits=12)


# Timestamps


@query(
    "SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, ((epoch_us(ts) % 1000000) // 1000)::INTEGER AS ms, (epoch_us(ts) % 1000)::INTEGER AS us, "
    "isodow(ts)::INTEGER AS dow, dayname(ts) AS name, dayofyear(ts) AS doy, ceil((dayofyear(ts) + isodow(date_trunc('year', ts)) - 1) / 7)::INTEGER AS wk, quarter(ts) AS q, "
    "day(last_day(make_date(year(ts), 2, 1))) = 29 AS leap, day(ts) = 1 AS month_start, ts::DATE = last_day(ts) AS month_end FROM events"
)
def ts_fields(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    whole = {
        "y": F.year(ts), "mo": F.month(ts), "d": F.dayofmonth(ts), "h": F.hour(ts), "mi": F.minute(ts), "s": F.second(ts), "ms": dt.millisecond(ts), "us": dt.microsecond(ts), "dow": dt.dayofweek(ts),
        "name": dt.day_name(ts), "doy": F.dayofyear(ts), "wk": dt.week(ts), "q": F.quarter(ts), "leap": dt.is_leap_year(ts), "month_start": dt.is_month_start(ts), "month_end": dt.is_month_end(ts),
    }
    found = table(spark, sf, "events").select("event_id", *[v.alias(n) for n, v in whole.items()])
    return found.withColumns({n: F.col(n).cast("long") for n in ("y", "mo", "d", "h", "mi", "s", "doy", "q")})


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS a, (year(o_orderdate) + (month(o_orderdate) > 3)::INTEGER)::VARCHAR AS a_mar, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q, "
    "(year(o_orderdate) + (month(o_orderdate) > 6)::INTEGER) || 'Q' || ((month(o_orderdate) + 5) % 12 // 3 + 1) AS q_jun, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders"
)
def ts_to_period(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", *[dt.to_period(c, f).alias(f.lower().replace("-", "_")) for f in ("A", "A-MAR", "Q", "Q-JUN", "M", "D")])


def _steps(fn: Callable[..., object]) -> Query:
    return lambda spark, sf: table(spark, sf, "events").select("event_id", *[fn(F.col("ts"), f).alias(f.lower()) for f in "DHTSL"])


_SHOW = {"d": "%Y-%m-%d", "h": "%Y-%m-%d %H", "t": "%Y-%m-%d %H:%M", "s": "%Y-%m-%d %H:%M:%S", "l": "%Y-%m-%d %H:%M:%S.%g"}


def _stepped(us: str) -> str:
    width = {"d": 86_400_000_000, "h": 3_600_000_000, "t": 60_000_000, "s": 1_000_000, "l": 1_000}
    return "SELECT event_id, " + ", ".join(f"strftime(make_timestamp(({us.format(w=w)}) // {w} * {w}), '{_SHOW[k]}') AS {k}" for k, w in width.items()) + " FROM events"


QUERIES |= {"ts_floor": _steps(dt.floor), "ts_ceil": _steps(dt.ceil), "ts_round": _steps(dt.round)}
SQL |= {"ts_floor": _stepped("epoch_us(ts)"), "ts_ceil": _stepped("epoch_us(ts) + {w} - 1"), "ts_round": _stepped("epoch_us(ts) + {w} // 2")}


@query("SELECT o_orderkey, strftime(o_orderdate, '%d-%b-%Y %I:%M %p %A') AS shown FROM orders")
def ts_strftime(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", dt.strftime(F.col("o_orderdate"), "%d-%b-%Y %I:%M %p %A").alias("shown"))


@query("SELECT o_orderkey, f.form::VARCHAR AS form, date_trunc('day', o_orderdate)::TIMESTAMP AS parsed FROM orders, (SELECT unnest(['iso', 'named', 'dots', 'compact', 'slashes', 'iso_time', 'words', 'month_first', 'twelve', 'clock', 'short', 'seconds']) AS form) f")
def ts_parse(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_orderdate")
    forms = {
        "iso": "yyyy-MM-dd", "named": "d MMM yyyy", "dots": "dd.MM.yyyy", "compact": "yyyyMMdd", "slashes": "yyyy/MM/dd", "iso_time": "yyyy-MM-dd'T'HH:mm:ss",
        "words": "MMMM d, yyyy, HH:mm", "month_first": "MM-dd-yyyy", "twelve": "yyyyMMddHHmm", "clock": "yyyy/MM/dd h:mm a", "short": "M/d/yy",
    }
    seconds = F.struct(F.lit("seconds").alias("form"), F.floor(dt.to_seconds(c.cast("timestamp_ntz"))).cast("string").alias("text"))
    texts = F.array(*[F.struct(F.lit(n).alias("form"), F.date_format(c, f).alias("text")) for n, f in forms.items()], seconds)
    rows = table(spark, sf, "orders").select("o_orderkey", F.explode(texts).alias("t"))
    return rows.select("o_orderkey", "t.form", dt.parse(F.col("t.text")).alias("parsed"))


@query("SELECT event_id, ts + INTERVAL 1 DAY + INTERVAL 23 HOUR AS later, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS since, floor(epoch_us(ts) / 1000) / 1000 AS seconds FROM events")
def ts_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", dt.add(ts, days=1, hours=23).alias("later"), dt.difference(ts, start).alias("since"), dt.to_seconds(ts).alias("seconds"))

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import dt as d
from sparkloom.functions.helpers import Timedelta

MOMENT = dt.datetime


def one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1999-02-09", MOMENT(1999, 2, 9)), ("1999/02/09", MOMENT(1999, 2, 9)), ("09-02-1999", MOMENT(1999, 9, 2)), ("02-09-1999", MOMENT(1999, 2, 9)),
        ("25-02-1999", MOMENT(1999, 2, 25)), ("09 Feb 1999", MOMENT(1999, 2, 9)), ("February 9, 1999", MOMENT(1999, 2, 9)), ("Feb-09-99", MOMENT(1999, 2, 9)),
        ("Feb 9, 1999, 14:30", MOMENT(1999, 2, 9, 14, 30)), ("19990209", MOMENT(1999, 2, 9)), ("09.02.1999", MOMENT(1999, 2, 9)),
        ("1999-02-09 14:30:45", MOMENT(1999, 2, 9, 14, 30, 45)), ("1999/02/09 2:30 PM", MOMENT(1999, 2, 9, 14, 30)), ("1999/02/09 2:30aM", MOMENT(1999, 2, 9, 2, 30)),
        ("1999-02-09T14:30", MOMENT(1999, 2, 9, 14, 30)), ("1999-02-09T14:30Z", MOMENT(1999, 2, 9, 14, 30)), ("199902091430", MOMENT(1999, 2, 9, 14, 30)),
        ("916722000", MOMENT(1999, 1, 19, 5)), ("916704000000", None), ("1167040000000", MOMENT(2006, 12, 25, 9, 46, 40)), ("5/6/29", MOMENT(2029, 5, 6)), ("5/6/30", MOMENT(1930, 5, 6)),
        ("nonsense", None), ("", None), (None, None), ("99/99/1999", None),
    ],
)
def test_parse(spark, text, want):
    assert one(spark, text, "string", d.parse) == want


def test_parse_day_first(spark):
    assert one(spark, "09-02-1999", "string", lambda c: d.parse(c, True)) == MOMENT(1999, 2, 9)


def test_fields(spark):
    at = lambda value, fn: one(spark, value, "timestamp_ntz", fn)
    december = MOMENT(2024, 12, 1)
    assert [at(december, f) for f in (d.dayofweek, d.day_name, d.is_leap_year, F.quarter, d.is_month_start)] == [7, "Sunday", True, 4, True]
    assert at(MOMENT(2024, 12, 31), d.is_month_end) and at(MOMENT(2024, 12, 30), d.week) == 53
    precise = MOMENT(1999, 2, 6, 8, 46, 39, 500_123)
    assert (at(precise, d.millisecond), at(precise, d.microsecond), at(precise, d.to_seconds)) == (500, 123, 918290799.5)
    assert at(precise, d.isoformat) == "1999-02-06T08:46:39.500123"
    start = MOMENT(1999, 1, 1)
    assert at(start, lambda c: d.add(c, days=-1, hours=-23)) == MOMENT(1998, 12, 30, 1) and at(start, lambda c: d.add(c, days=1, hours=23)) == MOMENT(1999, 1, 2, 23)
    assert at(start, lambda c: d.difference(d.add(c, seconds=2), c)) == 2_000_000
    assert at(start, lambda c: d.strftime(c, "%d-%b-%Y")) == "01-Jan-1999" and at(start, lambda c: d.strftime(c, "%q%% %H:%M")) == "%q% 00:00"
    assert one(spark, 916722000, "long", d.from_unix) == MOMENT(1999, 1, 19, 5) and one(spark, 1999, "long", lambda c: d.from_unix(c, "ns")) == MOMENT(1970, 1, 1, 0, 0, 0, 1)
    with pytest.raises(ValueError):
        d.from_unix(F.lit(1), "h")


def test_periods(spark):
    ts = MOMENT(2023, 12, 17, 14, 45, 30)
    want = {
        "Q": "2023Q4", "q-jan": "2024Q4", "Q-JUN": "2024Q2", "Q-OCT": "2024Q1", "Q-DEC": "2023Q4", "A": "2023", "A-jan": "2024", "A-APR": "2024", "A-DEC": "2023",
        "M": "2023-12", "D": "2023-12-17", "H": "2023-12-17 14:00", "T": "2023-12-17 14:45", "S": "2023-12-17 14:45:30",
    }
    for freq, label in want.items():
        assert one(spark, ts, "timestamp_ntz", lambda c: d.to_period(c, freq)) == label  # noqa: B023
    with pytest.raises(ValueError):
        d.to_period(F.lit(1), "W")


def test_steps(spark):
    ts = MOMENT(1999, 2, 6, 8, 46, 39, 500_500)
    day = "1999-02-0"
    want = {
        d.floor: ["6", "6 08", "6 08:46", "6 08:46:39", "6 08:46:39.500", "6 08:46:39.500500", "6 08:46:39.500500499"],
        d.ceil: ["7", "6 09", "6 08:47", "6 08:46:40", "6 08:46:39.501", "6 08:46:39.500501", "6 08:46:39.500500499"],
        d.round: ["6", "6 09", "6 08:47", "6 08:46:40", "6 08:46:39.501", "6 08:46:39.500500", "6 08:46:39.500500499"],
    }
    for fn, ends in want.items():
        assert [one(spark, ts, "timestamp_ntz", lambda c: fn(c, k, F.lit(499))) for k in "DHTSLUN"] == [day + e for e in ends]  # noqa: B023
    with pytest.raises(ValueError):
        d.floor(F.lit(1), "W")


def test_nanoseconds_and_spans(spark):
    at = lambda value, fn: one(spark, value, "timestamp_ntz", fn)
    start = MOMENT(1999, 2, 6, 8, 46, 39, 500_123)
    pair = lambda fn: tuple(at(start, fn))
    assert pair(lambda c: d.add_nanoseconds(c, 999, 2)) == (MOMENT(1999, 2, 6, 8, 46, 39, 500_124), 1)
    assert pair(lambda c: d.add_nanoseconds(c, 1, -2)) == (MOMENT(1999, 2, 6, 8, 46, 39, 500_122), 999)
    assert pair(lambda c: d.add_timedelta(c, Timedelta(days=1, nanoseconds=1500), 600)) == (MOMENT(1999, 2, 7, 8, 46, 39, 500_125), 100)
    assert pair(lambda c: d.add_timedelta(c, Timedelta(hours=-1, nanoseconds=-1))) == (MOMENT(1999, 2, 6, 7, 46, 39, 500_122), 999)
    assert at(start, d.time) == "8:46:39" and at(start, lambda c: d.to_local(c, "Europe/Berlin")) == "1999-02-06 09:46:39.500123"
    assert at(MOMENT(2024, 7, 1), lambda c: d.to_local(c, "Europe/Berlin")) == "2024-07-01 02:00:00.000"

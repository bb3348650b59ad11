"""Timestamps as columns, zoneless (UTC); nanoseconds beyond microseconds ride in a column of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.helpers import Timedelta

MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: Microseconds of the steps by their one-letter names.
STEPS = {"D": 86_400_000_000, "H": 3_600_000_000, "T": 60_000_000, "S": 1_000_000, "L": 1_000, "U": 1}
_SHOWN = {"D": "yyyy-MM-dd", "H": "yyyy-MM-dd HH", "T": "yyyy-MM-dd HH:mm", "S": "yyyy-MM-dd HH:mm:ss", "L": "yyyy-MM-dd HH:mm:ss.SSS", "U": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def year(c: Column) -> Column:
    return F.year(c)


def week(c: Column) -> Column:
    """Weeks begun since January 1, cut before Mondays; not the ISO week."""
    first = F.weekday(F.make_date(F.year(c), F.lit(1), F.lit(1)))
    return F.ceil((F.dayofyear(c) + first) / 7).cast("int")


def dayofweek(c: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(c) + 1


def day_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def millisecond(c: Column) -> Column:
    return F.floor(F.pmod(micros(c), F.lit(1_000_000)) / 1000).cast("int")


def microsecond(c: Column) -> Column:
    """Of the millisecond, 0 to 999."""
    return F.pmod(micros(c), F.lit(1000)).cast("int")


def is_leap_year(c: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(F.year(c), F.lit(2), F.lit(1)))) == 29


def is_month_start(c: Column) -> Column:
    return F.dayofmonth(c) == 1


def is_month_end(c: Column) -> Column:
    return F.to_date(c) == F.last_day(c)


def now(tz: str = "UTC") -> Column:
    """The time of the query in a time zone of the tz database."""
    return F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), tz).cast("timestamp_ntz")


def from_parts(year: Column, month: Column, day: Column, hour: Column | None = None, minute: Column | None = None, second: Column | None = None) -> Column:
    """From year, month and day, all of them needed, and a time; null where no such moment is."""
    hour, minute, second = (F.lit(0) if x is None else x for x in (hour, minute, second))
    return F.try_make_timestamp_ntz(year.cast("int"), month.cast("int"), day.cast("int"), hour.cast("int"), minute.cast("int"), second)


def from_unix(n: Column, unit: str = "s") -> Column:
    """From counts of s, ms, us or ns; ns are cut to microseconds."""
    us = {"s": n * 1_000_000, "ms": n * 1000, "us": n, "ns": F.floor(n / 1000).cast("long")}
    if unit not in us:
        raise ValueError("unit is s, ms, us or ns")
    return from_micros(us[unit].cast("long"))


def to_seconds(c: Column) -> Column:
    """Seconds since 1970 with milliseconds."""
    return F.floor(micros(c) / 1000) / 1000


def add(c: Column, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0, microseconds: int = 0) -> Column:
    return from_micros(micros(c) + F.lit(((days * 24 + hours) * 60 + minutes) * 60_000_000 + seconds * 1_000_000 + microseconds))


def add_nanoseconds(c: Column, nanos: Column | int, n: Column | int) -> Column:
    """struct(time, nanos): ``c`` and the ``nanos`` (0 to 999) beyond its microseconds, ``n`` nanoseconds later."""
    total = F.coalesce(F.lit(nanos), F.lit(0)).cast("long") + F.lit(n).cast("long")
    carried = F.floor(total / 1000).cast("long")
    return F.struct(from_micros(micros(c) + carried).alias("time"), F.pmod(total, F.lit(1000)).cast("int").alias("nanos"))


def add_timedelta(c: Column, span: Timedelta, nanos: Column | int = 0) -> Column:
    """struct(time, nanos) of a time and its nanoseconds, a span later; a negative span goes back."""
    whole, rest = divmod(span.total_nanoseconds, 1000)
    return add_nanoseconds(from_micros(micros(c) + F.lit(whole)), nanos, rest)


def time(c: Column) -> Column:
    """Hour, minute and second, as in 8:46:39."""
    return F.concat_ws(":", F.hour(c).cast("string"), F.minute(c).cast("string"), F.second(c).cast("string"))


def to_local(c: Column, tz: str | None = None) -> Column:
    """Text of the time in a zone of the tz database, or the session's: milliseconds, and microseconds where there are any."""
    zone = F.current_timezone() if tz is None else F.lit(tz)
    there = F.convert_timezone(F.lit("UTC"), zone, c.cast("timestamp_ntz"))
    return F.regexp_replace(F.date_format(there, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "000$", "")


def difference(a: Column, b: Column) -> Column:
    """Microseconds from ``b`` to ``a``."""
    return micros(a) - micros(b)


def isoformat(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def to_period(c: Column, freq: str) -> Column:
    """Label of the period: A, A-JAN..DEC, Q, Q-JAN..DEC (fiscal years that end in that month), M, D, H, T, S."""
    kind, _, ending = freq.upper().partition("-")
    shown = {"M": "yyyy-MM", "D": "yyyy-MM-dd", "H": "yyyy-MM-dd HH:00", "T": "yyyy-MM-dd HH:mm", "S": "yyyy-MM-dd HH:mm:ss"}
    if kind in shown and not ending:
        return F.date_format(c, shown[kind])
    if kind not in ("A", "Q") or (ending and ending not in MONTHS):
        raise ValueError(f"unknown period {freq!r}")
    # Moved so that the fiscal year ends in December.
    moved = F.add_months(c, 11 - MONTHS.index(ending or "DEC"))
    label = F.year(moved).cast("string")
    return label if kind == "A" else F.concat(label, F.lit("Q"), F.quarter(moved).cast("string"))


def _shown(us: Column, freq: str) -> Column:
    return F.date_format(from_micros(us), _SHOWN[freq])


def _step(freq: str) -> str:
    if freq.upper() not in (*STEPS, "N"):
        raise ValueError(f"unknown step {freq!r}")
    return freq.upper()


def _with_nanos(us: Column, nanos: Column) -> Column:
    return F.concat(_shown(us, "U"), F.lpad(nanos.cast("string"), 3, "0"))


def floor(c: Column, freq: str, nanosecond: Column | None = None) -> Column:
    """Text of the time cut to a step: D, H, T, S, L, U or N."""
    step, nanos = _step(freq), F.lit(0) if nanosecond is None else nanosecond
    return _with_nanos(micros(c), nanos) if step == "N" else _shown(micros(c), step)


def ceil(c: Column, freq: str, nanosecond: Column | None = None) -> Column:
    """Text of the first step that isn't earlier, steps counted from 1970 in UTC."""
    step, nanos = _step(freq), F.lit(0) if nanosecond is None else nanosecond
    if step == "N":
        return _with_nanos(micros(c), nanos)
    us = micros(c) + (nanos > 0).cast("long")
    return _shown(us + F.pmod(-us, F.lit(STEPS[step])), step)


def round(c: Column, freq: str, nanosecond: Column | None = None) -> Column:  # noqa: A001
    """Text of the nearest step; halves go up."""
    step, nanos = _step(freq), F.lit(0) if nanosecond is None else nanosecond
    if step == "N":
        return _with_nanos(micros(c), nanos)
    if step == "U":
        return _shown(micros(c) + (nanos >= 500).cast("long"), step)
    # Half a larger step is whole microseconds, which nanoseconds cannot fill up.
    half = micros(c) + F.lit(STEPS[step] // 2)
    return _shown(half - F.pmod(half, F.lit(STEPS[step])), step)


#: strftime codes and the patterns of the date formatter.
CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "z": "xx",
}


def strftime(c: Column, fmt: str) -> Column:
    """Text by strftime codes; unknown codes stand as they are, and %% is a percent sign."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            code = fmt[i + 1]
            out.append(F.date_format(c.cast("timestamp"), CODES[code]) if code in CODES else F.lit("%" if code == "%" else "%" + code))
            i += 2
        else:
            end = fmt.find("%", i + 1) if fmt[i] != "%" else i + 1
            end = len(fmt) if end < 0 else end
            out.append(F.lit(fmt[i:end]))
            i = end
    return F.concat(*out) if out else F.lit("")


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is worked out once, however often ``fn`` mentions it."""
    return F.transform(F.array(value), fn)[0]


def parse(c: Column, day_first: bool = False) -> Column:
    """Time from text in many forms; null where none fits.

    Forms: ISO; numbers apart by any marks, with a year of four digits anywhere or of
    two at the end (below 30: 2000s), month before day unless dots, ``day_first`` or a
    value above 12 say otherwise, then hour, minute, second; English month names;
    8 (date) or 12 (date, hour, minute) digits; 9 or 10 (seconds) or 13 (milliseconds).
    AM and PM are honoured.
    """
    num = lambda x: x.try_cast("int")
    numbers = lambda s: F.regexp_extract_all(s, F.lit("(\\d+)"), F.lit(1))
    iso = "^\\d{4}-\\d{2}-\\d{2}([ Tt]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?)?\\s*[Zz]?$"
    none = F.lit(None).cast("timestamp_ntz")

    def by_form(s: Column) -> Column:
        """The cheapest test that tells a text's form comes first; only its own form is worked out."""
        iso_time = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(s, "[Tt](?=\\d)", " "), "[Zz]$", "")).cast("timestamp_ntz")
        other = F.when(s.rlike("^\\d+$"), _compact(s)).otherwise(_once(F.lower(F.regexp_extract(s, _MONTH_NAME, 1)), lambda m: _once(numbers(s), lambda d: in_words(s, m, d))))
        return F.when(s.rlike(iso), iso_time).otherwise(other) if not day_first else other

    def in_words(s: Column, m: Column, d: Column) -> Column:
        facts = F.struct(
            F.transform(d, num).alias("n"), (F.array_position(F.transform(d, lambda x: F.char_length(x) == 4), True) - 1).cast("int").alias("wide"),
            s.rlike("(?i)\\d\\s*pm\\b").alias("pm"), s.rlike("(?i)\\d\\s*am\\b").alias("am"),
        )
        return _once(facts, lambda r: F.when(m != "", _named(r, m)).when(s.rlike("(?i)[b-ln-oq-z]"), none).otherwise(_apart(r, F.lit(day_first) | s.contains("."))))

    return _once(F.trim(c), by_form)


_MONTH_NAME = "(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"


def _two_digits(y: Column) -> Column:
    return y + F.when(y < 30, 2000).when(y < 100, 1900).otherwise(0)


def _clock(r: Column, n: Column, start: int) -> tuple[Column, Column, Column]:
    """Hour, minute and second from place ``start`` of numbers on; what is missing is 0."""
    hour, minute, second = (F.coalesce(F.get(n, start + i), F.lit(0)) for i in range(3))
    return F.when(r["pm"] & (hour < 12), hour + 12).when(r["am"] & (hour == 12), 0).otherwise(hour), minute, second


def _named(r: Column, month: Column) -> Column:
    """With a month name the numbers are day, year, hour, minute, second, or year, day, ..."""
    n = r["n"]
    number = F.floor((F.position(month, F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3)
    first = r["wide"] == 0
    return from_parts(F.when(first, F.get(n, 0)).otherwise(_two_digits(F.get(n, 1))), number, F.when(first, F.get(n, 1)).otherwise(F.get(n, 0)), *_clock(r, n, 2))


def _apart(r: Column, dotted: Column) -> Column:
    """Only numbers: the year is taken out, the rest are two of a date and a time."""
    n, wide = r["n"], r["wide"]
    place = F.when(wide >= 0, wide).otherwise(F.size(n) - 1)

    def of_rest(q: Column) -> Column:
        rest, year = q["rest"], q["year"]
        first, second = F.get(rest, 0), F.get(rest, 1)
        swap, one = dotted | (first > 12), F.size(rest) == 1
        return from_parts(
            F.when(wide >= 0, year).otherwise(_two_digits(year)), F.when(one, first).when(swap, second).otherwise(first),
            F.when(one, F.lit(1)).when(swap, first).otherwise(second), *_clock(r, rest, 2),
        )

    return _once(F.struct(F.filter(n, lambda x, i: i != place).alias("rest"), F.get(n, place).alias("year")), of_rest)


def _compact(s: Column) -> Column:
    """8 or 12 digits of a date, 9 or 10 of seconds, 13 of milliseconds."""
    part = lambda a, n: F.substring(s, a, n).try_cast("int")
    length, big = F.char_length(s), s.try_cast("long")
    return (
        F.when(length == 8, from_parts(part(1, 4), part(5, 2), part(7, 2)))
        .when(length == 12, from_parts(part(1, 4), part(5, 2), part(7, 2), part(9, 2), part(11, 2)))
        .when(length.isin(9, 10), from_unix(big, "s"))
        .when(length == 13, from_unix(big, "ms"))
    )

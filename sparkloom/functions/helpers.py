"""Small helpers on Python values, and chunks of tables."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice, zip_longest
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans import with_ordinal

_END = object()


def lists_equal(a: Sequence[Any], b: Sequence[Any]) -> bool:
    return len(a) == len(b) and all(x == y for x, y in zip(a, b, strict=True))


def iterables_equal(a: Iterable[Any], b: Iterable[Any]) -> bool:
    """Equal items in equal order, and equally many."""
    return all(x == y for x, y in zip_longest(a, b, fillvalue=_END))


def iterables_equal_unordered(a: Iterable[Any], b: Iterable[Any]) -> bool:
    return Counter(a) == Counter(b)


def sets_equal(a: Iterable[Any], b: Iterable[Any]) -> bool:
    return set(a) == set(b)


def count_contained(data: Iterable[Any], values: Iterable[Any]) -> int:
    """How many items are one of ``values``."""
    wanted = set(values)
    return sum(x in wanted for x in data)


def chunks(data: Iterable[Any], size: int) -> Iterator[list[Any]]:
    """Lists of ``size`` items, the last maybe shorter."""
    if size <= 0:
        raise ValueError("chunks have an item or more")
    items = iter(data)
    while part := list(islice(items, size)):
        yield part


def with_chunk(df: DataFrame, order_by: Sequence[str], size: int, name: str = "chunk") -> DataFrame:
    """Adds the number of the chunk of ``size`` rows in the given order."""
    if size <= 0:
        raise ValueError("chunks have a row or more")
    return with_ordinal(df, order_by, "__chunk_place").withColumn(name, F.floor(F.col("__chunk_place") / size).cast("long")).drop("__chunk_place")


def weighted_quantile_of(values: Sequence[float], weights: Sequence[float], qs: Sequence[float]) -> list[float]:
    """Of lists: the smallest value whose weight with all below reaches q of the whole; NaN without positive weights."""
    pairs = sorted((v, w) for v, w in zip(values, weights, strict=True) if w > 0 and v is not None and not math.isnan(v))
    total = math.fsum(w for _, w in pairs)
    out = []
    for q in qs:
        held, found = 0.0, math.nan
        for v, w in pairs:
            held, found = held + w, v
            if held >= q * total * (1 - 1e-12):
                break
        out.append(found)
    return out


@dataclass(frozen=True)
class Timedelta:
    """A span of time to the nanosecond."""

    days: int = 0
    hours: int = 0
    minutes: int = 0
    seconds: int = 0
    milliseconds: int = 0
    microseconds: int = 0
    nanoseconds: int = 0

    @property
    def total_nanoseconds(self) -> int:
        seconds = ((self.days * 24 + self.hours) * 60 + self.minutes) * 60 + self.seconds
        return (seconds * 1_000_000 + self.milliseconds * 1000 + self.microseconds) * 1000 + self.nanoseconds

    @property
    def total_microseconds(self) -> int:
        """For Spark's intervals, which end there; nanoseconds are cut off."""
        return self.total_nanoseconds // 1000

    def __str__(self) -> str:
        sign, left = ("-" if self.total_nanoseconds < 0 else ""), abs(self.total_nanoseconds)
        seconds, nanos = divmod(left, 1_000_000_000)
        return f"{sign}{seconds // 3600}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{nanos:09d}"


@dataclass
class Series:
    """Values with labels, as a row or a column of a frame."""

    values: list[Any]
    index: list[Any] = field(default_factory=list)
    name: Any = None

    def __post_init__(self) -> None:
        if not self.index:
            self.index = list(range(len(self.values)))
        if len(self.index) != len(self.values):
            raise ValueError(f"{len(self.index)} labels for {len(self.values)} values")

    def __len__(self) -> int:
        return len(self.values)

    def loc(self, label: Any) -> Any:
        """The value of a label, or all of a repeated one."""
        found = [v for x, v in zip(self.index, self.values, strict=True) if x == label]
        if not found:
            raise KeyError(label)
        return found[0] if len(found) == 1 else found

    def iloc(self, at: int) -> Any:
        return self.values[at]

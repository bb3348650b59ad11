"""Labelled, ordered tables.

A ``Frame`` is a DataFrame with a row number ``__ord``, a row label ``__ix`` and
columns ``c0``, ``c1``, ... whose labels (any value, repeats allowed) it keeps beside
them.  Frames don't change: methods give new ones, and those with ``inplace`` can rebind
the wrapper.  Labels or cells of mixed types are stored as JSON text.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sparkloom.functions.helpers import Series
from sparkloom.functions.missing import is_missing
from sparkloom.operators.frame_math import FrameMath
from sparkloom.plans import with_ordinal

ORD, IX = "__ord", "__ix"
NAN = float("nan")


def _missing(v: Any) -> bool:
    return v is None or (isinstance(v, float) and math.isnan(v))


def kind_of(values: Sequence[Any]) -> T.DataType | None:
    """The column type that holds all values: whole numbers with gaps become doubles; None for a mixture."""
    some = [v for v in values if not _missing(v)]
    gaps = any(isinstance(v, float) for v in values)
    if not some:
        return T.DoubleType()
    if all(isinstance(v, bool) for v in some):
        return T.BooleanType() if not gaps else None
    if any(isinstance(v, bool) for v in some):
        return None
    if all(isinstance(v, int) for v in some):
        return T.DoubleType() if gaps else T.LongType()
    if all(isinstance(v, (int, float)) for v in some):
        return T.DoubleType()
    if all(isinstance(v, str) for v in some):
        return T.StringType()
    if all(isinstance(v, dt.datetime) for v in some):
        return T.TimestampNTZType()
    return None


def encoded(v: Any) -> str | None:
    return None if _missing(v) else json.dumps(v, default=str)


def _cell(v: Any, kind: T.DataType | None) -> Any:
    if kind is None:
        return encoded(v)
    if isinstance(kind, T.DoubleType):
        return NAN if v is None else float(v)
    return None if _missing(v) else v


def expand_indices(spec: Sequence[int | Sequence[int]] | None) -> list[int] | None:
    """[0, [2, 4], 6] to [0, 2, 3, 4, 6]: pairs are ranges with both ends."""
    if spec is None:
        return None
    return [i for s in spec for i in (range(s[0], s[1] + 1) if isinstance(s, Sequence) else (s,))]


class Frame(FrameMath):
    def __init__(self, df: DataFrame, labels: Sequence[Any], objects: frozenset[str] = frozenset(), coded: bool = False):
        self.df, self.labels, self.objects, self.coded = df, list(labels), objects, coded

    # Construction

    @classmethod
    def from_columns(cls, spark: SparkSession, data: Mapping[Any, Any], columns: Sequence[Any] | None = None, index: Sequence[Any] | None = None) -> Frame:
        """Columns of equal length, single values for one row; ``columns`` picks and orders, unknown ones are NaN."""
        lists = {k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in data.items()}
        heights = {len(v) for v in lists.values()}
        if len(heights) > 1:
            raise ValueError("columns differ in length")
        n = heights.pop() if heights else 0
        names = list(lists) if columns is None else list(columns)
        rows = [[lists[c][i] if c in lists else NAN for c in names] for i in range(n)]
        return cls.from_rows(spark, rows, names, index)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Sequence[Any], columns: Sequence[Any] | None = None, index: Sequence[Any] | None = None) -> Frame:
        """Rows of cells, or single values for one column; short rows end in NaN."""
        rows = [list(r) if isinstance(r, (list, tuple)) else [r] for r in rows]
        width = max(map(len, rows), default=0)
        if not rows and columns is not None:
            width = len(columns)
        labels = list(range(width)) if columns is None else list(columns)
        index = list(range(len(rows))) if index is None else list(index)
        if len(labels) != width:
            raise ValueError(f"{len(labels)} column labels for {width} columns")
        if len(index) != len(rows):
            raise ValueError(f"{len(index)} row labels for {len(rows)} rows")
        rows = [r + [NAN] * (width - len(r)) for r in rows]
        kinds = [kind_of([r[j] for r in rows]) for j in range(width)]
        ix = kind_of(index) if index else T.LongType()
        fields = [T.StructField(ORD, T.LongType()), T.StructField(IX, ix or T.StringType())]
        fields += [T.StructField(f"c{j}", k or T.StringType()) for j, k in enumerate(kinds)]
        cells = [(i, _cell(x, ix), *(_cell(v, k) for v, k in zip(r, kinds, strict=True))) for i, (x, r) in enumerate(zip(index, rows, strict=True))]
        objects = frozenset(f"c{j}" for j, k in enumerate(kinds) if k is None)
        return cls(spark.createDataFrame(cells, T.StructType(fields)), labels, objects, ix is None)

    @classmethod
    def from_series(cls, spark: SparkSession, series: Sequence[Series], columns: Sequence[Any] | None = None) -> Frame:
        """A column for each series; labels that some lack leave gaps."""
        index = list(dict.fromkeys(x for s in series for x in s.index))
        held = [dict(zip(s.index, s.values, strict=True)) for s in series]
        labels = [s.name if s.name is not None else j for j, s in enumerate(series)] if columns is None else list(columns)
        return cls.from_rows(spark, [[h.get(x, NAN) for h in held] for x in index], labels, index)

    @classmethod
    def from_table(cls, df: DataFrame, order_by: Sequence[str], index: str | None = None) -> Frame:
        """A table in the order of some columns; ``index`` names the column of row labels."""
        names = [c for c in df.columns if c != index]
        numbered = with_ordinal(df, order_by, ORD)
        ix = F.col(index) if index else F.col(ORD)
        return cls(numbered.select(ORD, ix.alias(IX), *[F.col(c).alias(f"c{j}") for j, c in enumerate(names)]), names)

    def _new(self, df: DataFrame, labels: Sequence[Any] | None = None, objects: frozenset[str] | None = None, inplace: bool = False) -> Frame:
        out = Frame(df, self.labels if labels is None else labels, self.objects if objects is None else objects, self.coded)
        if inplace:
            self.__dict__ = out.__dict__
            return self
        return out

    # What there is

    @property
    def names(self) -> list[str]:
        return [f"c{j}" for j in range(len(self.labels))]

    @property
    def columns(self) -> list[Any]:
        return list(self.labels)

    @columns.setter
    def columns(self, labels: Sequence[Any]) -> None:
        if len(labels) != len(self.labels):
            raise ValueError(f"{len(labels)} column labels for {len(self.labels)} columns")
        self.labels = list(labels)

    @property
    def index(self) -> list[Any]:
        return [self._decoded(r[0], self.coded) for r in self.df.orderBy(ORD).select(IX).collect()]

    @index.setter
    def index(self, labels: Sequence[Any]) -> None:
        """New row labels, placed by row number."""
        if len(labels) != len(self):
            raise ValueError(f"{len(labels)} row labels for {len(self)} rows")
        kind = kind_of(labels) if len(labels) else T.LongType()
        schema = T.StructType([T.StructField(ORD, T.LongType()), T.StructField(IX, kind or T.StringType())])
        fresh = self.df.sparkSession.createDataFrame([(i, _cell(v, kind)) for i, v in enumerate(labels)], schema)
        self.df, self.coded = self.df.drop(IX).join(fresh, ORD).select(*self.df.columns), kind is None

    @property
    def values(self) -> list[list[Any]]:
        return [self._row(r) for r in self.df.orderBy(ORD).select(*self.names).collect()]

    def __len__(self) -> int:
        return self.df.count()

    @property
    def dtypes(self) -> dict[str, str]:
        return {n: "object" if n in self.objects else self.df.schema[n].dataType.simpleString() for n in self.names}

    @staticmethod
    def _decoded(v: Any, coded: bool) -> Any:
        return json.loads(v) if coded and v is not None else v

    def _row(self, row: Sequence[Any]) -> list[Any]:
        return [self._decoded(v, n in self.objects) for n, v in zip(self.names, row, strict=True)]

    def to_table(self) -> DataFrame:
        """A plain table with the labels as column names."""
        return self.df.select(*[F.col(n).alias(str(x)) for n, x in zip(self.names, self.labels, strict=True)])

    def table(self, row_index: bool = False, index_header: str = "") -> list[list[Any]]:
        """A header and all rows, as lists."""
        head = [[index_header] * row_index + self.columns]
        return head + [([i] if row_index else []) + r for i, r in zip(self.index, self.values, strict=True)]

    def info(self) -> DataFrame:
        """(position, label, non_null, dtype) of each column, from one pass."""
        counts = self.df.agg(*[F.count_if(~is_missing(self.df, n)).alias(n) for n in self.names])
        kinds = self.dtypes
        rows = F.array(*[F.struct(F.lit(j).alias("position"), F.lit(str(x)).alias("label"), F.col(n).alias("non_null"), F.lit(kinds[n]).alias("dtype")) for j, (n, x) in enumerate(zip(self.names, self.labels, strict=True))])
        return counts.select(F.explode(rows).alias("r")).select("r.*")

    def to_string(self, n: int = 20) -> str:
        """The first rows as centred text."""
        rows = [[str(c) for c in r] for r in self.head(n).table(row_index=True)]
        widths = [max(len(r[j]) for r in rows) for j in range(len(rows[0]))]
        return "\n".join(" ".join(c.center(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)

    # Columns

    def positions(self, label: Any) -> list[int]:
        found = [j for j, x in enumerate(self.labels) if x == label and type(x) is type(label)]
        if not found:
            raise KeyError(f"no column {label!r}")
        return found

    def name(self, label: Any) -> str:
        """The physical name of the first column with a label."""
        return f"c{self.positions(label)[0]}"

    def column(self, label: Any) -> list[Any]:
        """The values of a column, in order; of several with the label, a list of such lists."""
        found = self._pick(self.positions(label))
        columns = [list(c) for c in zip(*found.values, strict=True)] or [[] for _ in found.labels]
        return columns[0] if len(columns) == 1 else columns

    def _pick(self, positions: Sequence[int]) -> Frame:
        df = self.df.select(ORD, IX, *[F.col(f"c{p}").alias(f"c{j}") for j, p in enumerate(positions)])
        objects = frozenset(f"c{j}" for j, p in enumerate(positions) if f"c{p}" in self.objects)
        return self._new(df, [self.labels[p] for p in positions], objects)

    def select(self, *labels: Any) -> Frame:
        """The columns with these labels, in this order, each with its repeats."""
        return self._pick([p for x in labels for p in self.positions(x)])

    def __getitem__(self, label: Any) -> Any:
        return self.select(*label) if isinstance(label, list) else self.column(label)

    def __setitem__(self, label: Any, value: Column | Sequence[Any]) -> None:
        """``with_column`` in this frame."""
        self.__dict__ = self.with_column(label, value).__dict__

    def with_column(self, label: Any, value: Column | Sequence[Any]) -> Frame:
        """Replaces all columns of a label, or adds one; a list is placed by row number and must fit."""
        at = [j for j, x in enumerate(self.labels) if x == label and type(x) is type(label)]
        if isinstance(value, Column):
            df, kind = self.df.withColumn("__new", value), "column"
        else:
            kind = kind_of(value)
            if len(value) != len(self):
                raise ValueError(f"{len(value)} values for {len(self)} rows")
            schema = T.StructType([T.StructField(ORD, T.LongType()), T.StructField("__new", kind or T.StringType())])
            fresh = self.df.sparkSession.createDataFrame([(i, _cell(v, kind)) for i, v in enumerate(value)], schema)
            df = self.df.join(fresh, ORD)
        labels = self.labels if at else [*self.labels, label]
        for j in at or [len(self.labels)]:
            df = df.withColumn(f"c{j}", F.col("__new"))
        changed = {f"c{j}" for j in at or [len(self.labels)]}
        return self._new(df.drop("__new"), labels, frozenset((self.objects - changed) | (changed if kind is None else set())))

    def map_column(self, label: Any, fn: Callable[[Column], Column]) -> Frame:
        """``fn`` of a column's numbers, as double, in its place."""
        return self.with_column(label, fn(F.col(self.name(label)).cast("double")).cast("double"))

    def cast(self, label: Any, kind: str) -> Frame:
        return self.with_column(label, F.col(self.name(label)).try_cast(kind))

    # Rows

    def _code(self, label: Any) -> Column:
        return F.lit(encoded(label)) if self.coded else F.lit(label)

    def _is(self, label: Any) -> Column:
        """Rows with a label; text that looks like a number also finds that number."""
        kind = self.df.schema[IX].dataType
        if self.coded:
            either = F.col(IX) == F.lit(encoded(label))
            return either | (F.col(IX) == F.lit(label)) if isinstance(label, str) and label.lstrip("-").isdigit() else either
        if isinstance(kind, T.LongType) and isinstance(label, str):
            return F.col(IX) == int(label) if label.lstrip("-").isdigit() else F.lit(False)
        if isinstance(kind, T.StringType) != isinstance(label, str):
            return F.lit(False)
        return F.col(IX) == F.lit(label)

    def _renumbered(self, df: DataFrame) -> DataFrame:
        return with_ordinal(df.drop(ORD) if ORD not in df.columns else df.withColumnRenamed(ORD, "__was"), ["__was"], ORD).drop("__was")

    def _find(self, label: Any) -> int:
        """The number of the first row with a label."""
        first = self.df.filter(self._is(label)).agg(F.min(ORD)).first()[0]
        if first is None:
            raise KeyError(f"no row {label!r}")
        return first

    def head(self, n: int = 5) -> Frame:
        return self._new(self.df.filter(F.col(ORD) < n))

    def reset_index(self, inplace: bool = False) -> Frame:
        out = self._new(self.df.withColumn(IX, F.col(ORD)))
        out.coded = False
        if inplace:
            self.__dict__ = out.__dict__
            return self
        return out

    def drop(self, label: Any, axis: int = 0, select: int | None = None, inplace: bool = False) -> Frame:
        """Without the rows (axis 0) or columns (axis 1) of a label, or only its ``select``-th (from 0)."""
        if axis == 1:
            gone = self.positions(label)
            gone = gone if select is None else [gone[select]]
            kept = self._pick([j for j in range(len(self.labels)) if j not in gone])
            return self._new(kept.df, kept.labels, kept.objects, inplace)
        self._find(label)
        hit = self._is(label)
        if select is None:
            rows = self.df.filter(~hit)
        else:
            nth = F.row_number().over(W.partitionBy(IX).orderBy(ORD)) - 1
            rows = self.df.withColumn("__nth", nth).filter(~(hit & (F.col("__nth") == select))).drop("__nth")
        return self._new(self._renumbered(rows), inplace=inplace)

    def rename(self, index: Mapping[Any, Any] | None = None, columns: Mapping[Any, Any] | None = None, at_index: int | None = None, at_col: int | None = None, inplace: bool = False) -> Frame:
        """New labels for old, for all rows and columns that have them or for the n-th (from 0)."""
        if index is None and columns is None:
            raise ValueError("neither row nor column labels to rename")
        labels = self.columns
        for old, new in (columns or {}).items():
            places = self.positions(old)
            for j in places if at_col is None else [places[at_col]]:
                labels[j] = new
        df, coded = self.df, self.coded
        if index:
            if not coded and kind_of([*index.values()]) != df.schema[IX].dataType:
                kind = df.schema[IX].dataType
                text = F.to_json(F.struct(F.col(IX).alias("v")))
                df = df.withColumn(IX, F.regexp_extract(text, '^\\{"v":(.*)\\}$', 1) if not isinstance(kind, T.StringType) else F.regexp_extract(text, '(?s)^\\{"v":(.*)\\}$', 1))
                coded = True
            base = Frame(df, labels, self.objects, coded)
            nth = F.row_number().over(W.partitionBy(IX).orderBy(ORD)) - 1
            ix, df = F.col(IX), df.withColumn("__nth", nth) if at_index is not None else df
            for old, new in index.items():
                base._find(old)
                hit = base._is(old) if at_index is None else base._is(old) & (F.col("__nth") == at_index)
                ix = F.when(hit, base._code(new)).otherwise(ix)
            df = df.withColumn(IX, ix).drop("__nth")
        out = Frame(df, labels, self.objects, coded)
        if inplace:
            self.__dict__ = out.__dict__
            return self
        return out

    def sort(self, label: Any, ascending: bool = True, nulls_first: bool = True, key: Callable[[Column], Column] | None = None, select: int = 0, inplace: bool = False) -> Frame:
        """By one column: text by its first letter without case, then as it is; ties keep their order.

        ``nulls_first`` is turned round by descending order, as all of the comparison is.
        """
        n = f"c{self.positions(label)[select]}"
        c = F.col(n)
        gap = is_missing(self.df, n)
        if key is not None:
            parts = [key(c)]
        elif isinstance(self.df.schema[n].dataType, T.StringType):
            parts = [F.upper(F.substring(c, 1, 1)), c]
        else:
            parts = [c]
        order = [(~gap if nulls_first else gap).cast("int"), *[F.when(~gap, p) for p in parts]]
        names = [f"__k{i}" for i in range(len(order))]
        rows = self.df.withColumnRenamed(ORD, "__was").withColumns(dict(zip(names, order, strict=True)))
        by = [F.col(k).asc() if ascending else F.col(k).desc() for k in names]
        return self._new(with_ordinal(rows, [*by, F.col("__was")], ORD).drop("__was", *names), inplace=inplace)

    def reindex(self, order: Sequence[Any] | Mapping[Any, Any], select: int = 0, inplace: bool = False) -> Frame:
        """Rows in the order of all labels (repeats in turn), or one row {a: b} moved to where b stands."""
        nth = F.row_number().over(W.partitionBy(IX).orderBy(ORD)) - 1
        if isinstance(order, Mapping):
            (a, b), *more = order.items()
            if more:
                raise ValueError("one row is moved at a time")
            places = [r[0] for r in self.df.filter(self._is(a)).orderBy(ORD).select(ORD).limit(select + 1).collect()]
            if len(places) <= select:
                raise KeyError(f"no row {a!r}")
            start, stop = places[select], self._find(b)
            shift = F.when(F.col(ORD) == start, F.lit(stop))
            if start < stop:
                shift = shift.when(F.col(ORD).between(start + 1, stop), F.col(ORD) - 1)
            elif start > stop:
                shift = shift.when(F.col(ORD).between(stop, start - 1), F.col(ORD) + 1)
            return self._new(self.df.withColumn(ORD, shift.otherwise(F.col(ORD))), inplace=inplace)
        seen: dict[Any, int] = {}
        wanted = []
        for i, x in enumerate(order):
            wanted.append((i, encoded(x) if self.coded else x, seen.get(x, 0)))
            seen[x] = seen.get(x, 0) + 1
        kind = self.df.schema[IX].dataType
        want = self.df.sparkSession.createDataFrame(wanted, T.StructType([T.StructField("__to", T.LongType()), T.StructField(IX, kind), T.StructField("__nth", T.IntegerType())]))
        moved = self.df.withColumn("__nth", nth.cast("int")).join(want, [IX, "__nth"])
        if moved.count() != len(wanted) or len(wanted) != len(self):
            raise ValueError("a list must name every row once")
        return self._new(moved.withColumn(ORD, F.col("__to")).drop("__to", "__nth"), inplace=inplace)

    # Positions and labels

    @property
    def iloc(self) -> Iloc:
        return Iloc(self)

    def loc(self, row: Any = None, col: Any = None, edit: Any = None) -> Any:
        """Rows and columns by label; see ``Loc`` rules below.

        row: a label (its values, or a frame if it repeats), {a: b} (from a up to but
        without b; to the end if b is None) or a list of all labels.  col: a label, a list
        or {a: b} with both ends.  ``edit`` puts a value into all cells found, widening types.
        """
        rows = self
        if isinstance(row, Mapping):
            (a, b), *_ = row.items()
            start, stop = self._find(a), None if b is None else self._find(b)
            hit = (F.col(ORD) >= start) & (F.col(ORD) < stop) if stop is not None else F.col(ORD) >= start
        elif isinstance(row, list):
            rows, hit = self.reindex(row), F.lit(True)
        elif row is None:
            hit = F.lit(True)
        else:
            self._find(row)
            hit = self._is(row)
        if isinstance(col, Mapping):
            (a, b), *_ = col.items()
            columns = list(range(self.positions(a)[0], (self.positions(b)[0] if b is not None else len(self.labels) - 1) + 1))
        elif isinstance(col, list):
            columns = [p for x in col for p in self.positions(x)]
        else:
            columns = list(range(len(self.labels))) if col is None else self.positions(col)
        if edit is not None:
            return rows._edited(hit, columns, edit)
        found = rows._new(rows.df.filter(hit))._pick(columns)
        if row is not None and not isinstance(row, (Mapping, list)):
            lists = found.values
            if len(lists) == 1:
                return lists[0][0] if col is not None and not isinstance(col, (list, Mapping)) and len(columns) == 1 else lists[0]
        return found._new(found._renumbered(found.df))

    def _edited(self, hit: Column, columns: Sequence[int], value: Any) -> Frame:
        df, objects = self.df, set(self.objects)
        for j in columns:
            n = f"c{j}"
            old, new = df.schema[n].dataType, kind_of([value])
            if n in objects:
                df = df.withColumn(n, F.when(hit, F.lit(encoded(value))).otherwise(F.col(n)))
            elif old == new or (isinstance(old, T.DoubleType) and isinstance(new, T.LongType)):
                df = df.withColumn(n, F.when(hit, F.lit(value).cast(old)).otherwise(F.col(n)))
            elif isinstance(old, T.LongType) and isinstance(new, T.DoubleType):
                df = df.withColumn(n, F.when(hit, F.lit(value).cast("double")).otherwise(F.col(n).cast("double")))
            else:
                text = F.regexp_extract(F.to_json(F.struct(F.col(n).alias("v"))), '(?s)^\\{"v":(.*)\\}$', 1)
                df = df.withColumn(n, F.when(hit, F.lit(encoded(value))).when(F.col(n).isNotNull(), text))
                objects.add(n)
        return self._new(df, objects=frozenset(objects))

    # Together

    def append(self, rows: Any, index: Sequence[Any] | None = None, columns: Sequence[Any] | None = None, ignore_index: bool = False, inplace: bool = False) -> Frame:
        """Rows added below: lists, single values (one column), a mapping or mappings by label, or a frame."""
        spark = self.df.sparkSession
        if isinstance(rows, Frame):
            more = rows
        elif isinstance(rows, Series):
            more = Frame.from_rows(spark, [rows.values], rows.index, [rows.name] if rows.name is not None and index is None else index)
        elif isinstance(rows, Mapping):
            if not ignore_index and index is None:
                raise ValueError("a mapping has no row labels: pass index or ignore_index")
            more = Frame.from_columns(spark, rows, index=index)
        elif rows and isinstance(rows[0], Mapping):
            keys = list(dict.fromkeys(k for r in rows for k in r))
            more = Frame.from_rows(spark, [[r.get(k, NAN) for k in keys] for r in rows], keys, index)
        else:
            lists = [list(r) if isinstance(r, (list, tuple)) else [r] for r in rows]
            if any(len(r) > len(self.labels) for r in lists):
                raise ValueError("a row is wider than the frame")
            lists = [r + [NAN] * (len(self.labels) - len(r)) for r in lists]
            more = Frame.from_rows(spark, lists, self.labels if columns is None else columns, index)
        return concat([self, more], ignore_index=ignore_index, into=self if inplace else None)


class RowCells(list):
    """The cells of a row, in order; one that is set here is set in the frame."""

    def __init__(self, iloc: Iloc, row: int, cells: Sequence[Any]):
        super().__init__(cells)
        self._iloc, self._at = iloc, row

    def __setitem__(self, col: int, value: Any) -> None:
        super().__setitem__(col, value)
        self._iloc[self._at, range(len(self))[col]] = value


class Iloc:
    """Rows, and then columns, by position: a number, a list of numbers, or a slice without its end."""

    def __init__(self, frame: Frame):
        self.frame = frame

    def _bounded(self, s: slice, n: int) -> tuple[int, int]:
        a, b = s.start or 0, n if s.stop is None else s.stop
        if not 0 <= a <= b <= n:
            raise IndexError(f"{a}:{b} of {n}")
        return a, b

    def __getitem__(self, at: Any) -> Any:
        f = self.frame
        row, col = at if isinstance(at, tuple) else (at, None)
        if col is not None:
            n = len(f.labels)
            places = [col] if isinstance(col, int) else list(range(*self._bounded(col, n))) if isinstance(col, slice) else list(col)
            if any(not 0 <= p < n for p in places):
                raise IndexError(f"columns {places} of {n}")
            f = f._pick(places)
        if isinstance(row, int):
            found = f.df.filter(F.col(ORD) == row).select(*f.names).collect()
            if not found:
                raise IndexError(f"row {row}")
            cells = f._row(found[0])
            return cells[0] if isinstance(col, int) else cells if col is not None else RowCells(self, row, cells)
        n = len(f)
        if isinstance(row, slice):
            a, b = self._bounded(row, n)
            return f._new(f.df.filter((F.col(ORD) >= a) & (F.col(ORD) < b)).withColumn(ORD, F.col(ORD) - a))
        if any(not 0 <= r < n for r in row):
            raise IndexError(f"rows {row} of {n}")
        want = f.df.sparkSession.createDataFrame([(i, r) for i, r in enumerate(row)], f"__to long, {ORD} long")
        return f._new(f.df.join(want, ORD).withColumn(ORD, F.col("__to")).drop("__to"))

    def __setitem__(self, at: Any, value: Any) -> None:
        """Cells of a row, or of rows, replaced in this frame; lengths must fit."""
        f = self.frame
        if isinstance(at, tuple):
            f.__dict__ = f._edited(F.col(ORD) == at[0], [at[1]], value).__dict__
            return
        rows = [(at, value)] if isinstance(at, int) else list(zip(at, value, strict=True))
        for r, cells in rows:
            if len(cells) != len(f.labels):
                raise ValueError(f"{len(cells)} cells for {len(f.labels)} columns")
            if not 0 <= r < len(f):
                raise IndexError(f"row {r}")
            out = f
            for j, v in enumerate(cells):
                out = out._edited(F.col(ORD) == r, [j], v)
            f.__dict__ = out.__dict__


def _widened(frames: Sequence[tuple[DataFrame, str | None, bool]], out: str) -> tuple[list[Column], bool]:
    """The columns (or gaps) of several frames brought to one type; whether it is JSON text."""
    kinds = [df.schema[n].dataType for df, n, _ in frames if n is not None]
    gaps = any(n is None for _, n, _ in frames)
    mixed = any(o for _, n, o in frames if n is not None) or len({type(k) for k in kinds} - {T.LongType, T.DoubleType}) > (1 if not any(isinstance(k, (T.LongType, T.DoubleType)) for k in kinds) else 0)
    numeric = all(isinstance(k, (T.LongType, T.DoubleType)) for k in kinds)
    if mixed:
        text = lambda n: F.regexp_extract(F.to_json(F.struct(F.col(n).alias("v"))), '(?s)^\\{"v":(.*)\\}$', 1)
        return [F.lit(None).cast("string").alias(out) if n is None else (F.col(n) if o else F.when(F.col(n).isNotNull(), text(n))).alias(out) for _, n, o in frames], True
    if numeric:
        double = gaps or any(isinstance(k, T.DoubleType) for k in kinds)
        kind = T.DoubleType() if double else T.LongType()
        return [(F.lit(NAN) if n is None else F.col(n)).cast(kind).alias(out) for _, n, _ in frames], False
    return [(F.lit(None) if n is None else F.col(n)).cast(kinds[0]).alias(out) for _, n, _ in frames], False


def _occurrences(labels: Sequence[Any]) -> list[tuple[str, Any, int]]:
    seen: dict[tuple[str, Any], int] = {}
    out = []
    for x in labels:
        key = (type(x).__name__, x)
        out.append((*key, seen.get(key, 0)))
        seen[key] = seen.get(key, 0) + 1
    return out


def concat(frames: Sequence[Frame], axis: int = 0, join: str = "outer", ignore_index: bool = False, positional: bool = False, into: Frame | None = None) -> Frame:
    """Frames below one another (axis 0) or side by side (axis 1).

    Axis 0: the union of columns with NaN for gaps (outer), or those common to all in
    the first frame's order (inner).  Axis 1: rows meet by label, all of them in order
    of first appearance (outer) or those in every frame, each label's first (inner);
    ``positional`` pastes rows by number instead.  Repeated columns are kept.
    """
    if join not in ("outer", "inner") or axis not in (0, 1):
        raise ValueError("axis is 0 or 1, join is outer or inner")
    out = (_below if axis == 0 else _beside)(list(frames), join, positional)
    if ignore_index:
        out = out.reset_index()
    if into is not None:
        into.__dict__ = out.__dict__
        return into
    return out


def _below(frames: list[Frame], join: str, positional: bool) -> Frame:
    keys = [_occurrences(f.labels) for f in frames]
    if join == "inner":
        wanted = [k for k in keys[0] if all(k in other for other in keys[1:])]
    else:
        wanted = list(dict.fromkeys(k for ks in keys for k in ks))
    columns = {}
    objects = set()
    for j, k in enumerate(wanted):
        parts = [(f.df, f"c{ks.index(k)}" if k in ks else None, k in ks and f"c{ks.index(k)}" in f.objects) for f, ks in zip(frames, keys, strict=True)]
        columns[j], text = _widened(parts, f"c{j}")
        if text:
            objects.add(f"c{j}")
    index, coded = _widened([(f.df, IX, f.coded) for f in frames], IX)
    tables, before = [], 0
    for i, f in enumerate(frames):
        tables.append(f.df.select((F.col(ORD) + before).alias(ORD), index[i], *[columns[j][i] for j in columns]))
        before += len(f)
    return Frame(reduce(DataFrame.unionByName, tables), [k[1] for k in wanted], frozenset(objects), coded)


def _beside(frames: list[Frame], join: str, positional: bool) -> Frame:
    labels = [x for f in frames for x in f.labels]
    index, coded = _widened([(f.df, IX, f.coded) for f in frames], IX)
    objects: set[str] = set()
    joined, at = None, 0
    for i, f in enumerate(frames):
        names = {n: f"c{at + j}" for j, n in enumerate(f.names)}
        objects |= {names[n] for n in f.objects}
        t = f.df.select(F.col(ORD).alias(f"__o{i}"), index[i], *[F.col(n).alias(m) for n, m in names.items()])
        if positional:
            t = t.withColumn("__on", F.col(f"__o{i}"))
        elif join == "inner":
            first = t.groupBy(IX).agg(F.min(f"__o{i}").alias(f"__o{i}"))
            t = t.join(first, [IX, f"__o{i}"]).withColumn("__on", F.col(IX))
        else:
            # Repeats of a label meet in turn.
            t = t.withColumn("__on", F.struct(F.col(IX), F.row_number().over(W.partitionBy(IX).orderBy(f"__o{i}"))))
        t = t.withColumnRenamed(IX, f"__ix{i}")
        joined = t if joined is None else joined.join(t, "__on", "inner" if join == "inner" else "full")
        at += len(f.labels)
    order = F.struct(*[F.coalesce(F.col(f"__o{i}"), F.lit(1 << 62)) for i in range(len(frames))])
    joined = joined.withColumn("__was", order).withColumn(IX, F.coalesce(*[F.col(f"__ix{i}") for i in range(len(frames))]))
    gaps = []
    for j in range(len(labels)):
        kind = joined.schema[f"c{j}"].dataType
        numeric = isinstance(kind, (T.LongType, T.DoubleType)) and join == "outer" and not (positional and len(frames) == 1)
        gaps.append(F.coalesce(F.col(f"c{j}").cast("double"), F.lit(NAN)).alias(f"c{j}") if numeric else F.col(f"c{j}"))
    numbered = with_ordinal(joined.select("__was", IX, *gaps), ["__was"], ORD).drop("__was")
    return Frame(numbered.select(ORD, IX, *[f"c{j}" for j in range(len(labels))]), labels, frozenset(objects), coded)

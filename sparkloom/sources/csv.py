"""CSV files and text as frames, and frames as CSV."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.frame import IX, ORD, Frame, encoded, expand_indices
from sparkloom.plans import with_ordinal


def _framed(
    lines: DataFrame, rows: Sequence | None, columns: Sequence | None, has_header: bool, has_index: bool, new_header: Sequence[Any] | None,
    convert: Mapping[Any, Callable[[Column], Column]] | None, names: list[str],
) -> Frame:
    """``lines`` has ORD and one text or typed column a field; ``names`` are the header's words or numbers."""
    fields = [c for c in lines.columns if c != ORD]
    wanted = expand_indices(columns)
    places = list(range(1 if has_index else 0, len(fields))) if wanted is None else [p for p in wanted if not (has_index and p == 0)]
    chosen = expand_indices(rows)
    if chosen is not None:  # the header is row 0
        lines = lines.filter((F.col(ORD) + int(has_header)).isin([r for r in chosen if not (has_header and r == 0)]))
        lines = with_ordinal(lines.withColumnRenamed(ORD, "__was"), ["__was"], ORD).drop("__was")
    labels: list[Any] = [names[p] for p in places] if has_header else list(range(len(places)))
    if new_header is not None:
        if len(new_header) != len(places):
            raise ValueError(f"{len(new_header)} labels for {len(places)} columns")
        labels = list(new_header)
    cells = []
    for j, p in enumerate(places):
        c = F.col(fields[p])
        how = (convert or {}).get(labels[j])
        cells.append((how(c) if how else c).alias(f"c{j}"))
    ix = F.col(fields[0]) if has_index else F.col(ORD)
    return Frame(lines.select(ORD, ix.alias(IX), *cells), labels)


def read_csv(
    spark: SparkSession, path: str, rows: Sequence | None = None, columns: Sequence | None = None, has_header: bool = True, has_index: bool = False,
    new_header: Sequence[Any] | None = None, convert: Mapping[Any, Callable[[Column], Column]] | None = None, delimiter: str = ",", quote: str = '"',
    eol: str | None = None, numeric: bool = True, allow_invalid: bool = True,
) -> Frame:
    """A file or folder of files in the order of their names and lines.

    ``rows`` counts the header as row 0; rows and columns may hold [first, last] ranges.
    ``convert`` maps labels to functions of the column.  With ``numeric`` types are
    inferred in a pass of their own; else all cells are trimmed text.
    """
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("header", has_header).option("inferSchema", numeric)
    reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE" if allow_invalid else "FAILFAST")
    reader = reader.option("multiLine", True) if eol is None else reader.option("lineSep", eol)
    df = reader.csv(path)
    names = list(df.columns)
    df = df.toDF(*[f"f{i}" for i in range(len(names))])
    place = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__line"))
    lines = with_ordinal(place, ["__file", "__at", "__line"], ORD).drop("__file", "__at", "__line")
    return _framed(lines.select(ORD, *[f"f{i}" for i in range(len(names))]), rows, columns, has_header, has_index, new_header, convert, names)


def read_csv_text(
    spark: SparkSession, text: str, rows: Sequence | None = None, columns: Sequence | None = None, has_header: bool = True, has_index: bool = False,
    new_header: Sequence[Any] | None = None, convert: Mapping[Any, Callable[[Column], Column]] | None = None, delimiter: str = ",", quote: str = '"', eol: str = "\n",
) -> Frame:
    """Text in memory; cells are text."""
    import csv
    import io

    found = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text.replace(eol, "\n")), delimiter=delimiter, quotechar=quote) if r]
    names = found[0] if has_header and found else [str(i) for i in range(max(map(len, found), default=0))]
    body = found[1:] if has_header else found
    schema = ", ".join([f"{ORD} long", *[f"f{i} string" for i in range(len(names))]])
    lines = spark.createDataFrame([(i, *(r + [None] * (len(names) - len(r)))[: len(names)]) for i, r in enumerate(body)], schema)
    return _framed(lines, rows, columns, has_header, has_index, new_header, convert, names)


def to_csv(frame: Frame, path: str | None = None, index: bool = False) -> str | None:
    """Written in order as a folder of quoted part files with headers, or returned as one text if no path is given."""
    table = frame.df.select(*([F.col(IX).alias("__index")] if index else []), ORD, *[F.col(n) for n in frame.names])
    ordered = table.orderBy(ORD).drop(ORD)
    labels = [""] * index + [str(x) for x in frame.labels]
    if path is None:
        import csv
        import io

        out = io.StringIO()
        write = csv.writer(out, lineterminator="\n")
        write.writerow(labels)
        for row in frame.table(row_index=index)[1:]:
            write.writerow(["null" if v is None else "NaN" if v != v else v if not isinstance(v, (list, dict)) else encoded(v) for v in row])
        return out.getvalue()
    if len(set(map(str.lower, labels))) == len(labels) and "" not in labels:
        ordered.toDF(*labels).write.option("header", True).option("nullValue", "null").option("nanValue", "NaN").csv(path)
        return None
    # Repeated labels can't name columns: the header becomes a line of its own before the rows.
    body = ordered.select(F.to_csv(F.struct(*ordered.columns), {"nullValue": "null", "nanValue": "NaN"}).alias("value"))
    head = frame.df.sparkSession.createDataFrame([(",".join(labels),)], "value string")
    head.coalesce(1).unionByName(body).write.text(path)
    return None

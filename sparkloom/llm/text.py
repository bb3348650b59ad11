"""What several corpus operators share: words, lower case and hash folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

WORD_GAP = "[\\x20\\x09-\\x0D]+"
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_column(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """UTF-8 words of a text; ``bytes.split`` cuts at exactly the same six characters."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(ASCII_LOWER) if lower else raw).split()


def trim() -> None:
    """Give memory that is free back to the system: workers serve one task after another."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about ``most``."""
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= most or i + 1 == len(sizes):
            yield begin, i + 1
            begin, held = i + 1, 0


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", most: int = 4 << 20, extra: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``most`` bytes of text, and of what each row has in ``extra`` besides."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[text_col]), 0).to_numpy(zero_copy_only=False)
        if extra:
            sizes = sizes + batch[extra].to_numpy(zero_copy_only=False)
        for begin, end in runs(sizes, most):
            yield batch.slice(begin, end - begin)
        trim()


def in_pieces(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, text_col: str = "text", most: int = 4 << 20, extra: str | None = None) -> DataFrame:
    """``fn`` of pieces of about ``most`` bytes of text (and ``extra``): whole texts, but never many at once."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text_col, most, extra):
            yield pa.RecordBatch.from_pandas(fn(piece.to_pandas()), schema=arrow, preserve_index=False)

    return df.mapInArrow(run, schema)

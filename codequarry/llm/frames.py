"""Helpers that the operators share: folds, fresh column names, row numbers, slices of Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that the vectorised code looks at together; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str) -> Column:
    """True for the third of the ids that no model learns from (a null id counts as not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that clash with none of the frame's (case does not matter)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


class RowNumbers:
    """Numbers unique over all tasks of a stage. They are stable only once the rows are written."""

    def __init__(self) -> None:
        self.next = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

    def take(self, n: int) -> np.ndarray:
        self.next += n
        return np.arange(self.next - n, self.next, dtype=np.int64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, column.offset + len(column) + 1)[column.offset:]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes together, or of one longer row."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Rows of values between neighbouring bounds as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def extended(df: DataFrame, more: str) -> StructType:
    """The frame's schema and the columns of a DDL string after them."""
    return StructType(df.schema.fields + StructType.fromDDL(more).fields)


def with_columns(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    keep = [i for i, c in enumerate(batch.schema.names) if c not in drop]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + arrays, [batch.schema.names[i] for i in keep] + names)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))

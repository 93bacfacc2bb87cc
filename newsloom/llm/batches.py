"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of A-Z-lower-cased UTF-8 text."""
    return text.translate(WORD_BYTES).split()


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that ``column`` holds about ``max_bytes`` in each piece."""
    lengths = pa.compute.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null counts as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' UTF-8 bytes end to end, and the row bounds (rows + 1); null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def list_array(values: np.ndarray, sizes, kind: pa.DataType) -> pa.Array:
    """A list column from all values end to end and each row's number of values."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    column: str,
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    max_bytes: int = 8 << 20,
) -> DataFrame:
    """Adds ``fields``, computed batch by batch from string column ``column``.

    ``make()`` runs once a task and returns the function from a batch to the new
    columns.  Columns of ``df`` that bear a new name are replaced.  No shuffle.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept]
    df = df if column in names else df.withColumn("__input", df[column])
    used = column if column in names else "__input"

    def run(source):
        compute = make()
        for whole in source:
            for batch in pieces(whole, used, max_bytes):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n) for n in names] + compute(batch), names=names + [f.name for f in fields]
                )
        # workers go on to other tasks: they should not hold what this one needed
        whole = batch = compute = None
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, T.StructType(kept + fields))

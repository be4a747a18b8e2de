"""What the corpus operators share: words, hold-out folds, Arrow batches and bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.session import forget, read_table, shared_dir, small_batches, stored

__all__ = ["WORD", "batches", "fold", "forget", "letters", "mapped", "read_table", "shared_dir", "stored", "text_bytes"]

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id falls in fold 0."""
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)), F.lit(n)).cast("int")


def letters(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def mapped(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` over batches that are bounded by bytes, so that a task's memory does not depend on the texts' lengths."""
    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the ``len + 1`` offsets of the rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def batches(source: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose texts hold about ``most`` bytes together (one longer text is a slice of its own)."""
    for batch in source:
        flat, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield batch.slice(row, end - row), flat[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end

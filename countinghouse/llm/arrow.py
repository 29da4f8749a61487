"""Small helpers for operators that map Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rows = Callable[[list], list]


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``text`` alone (null: empty), so other columns cannot clash."""
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def bytes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``texts_of`` with the text as UTF-8 bytes."""
    return texts_of(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))


def unused(columns: list[str], name: str) -> str:
    """``name``, longer by as many underscores as it takes to be none of ``columns``."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name += "_"
    return name


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list for each numpy array."""
    ends = np.cumsum([0, *(len(part) for part in parts)], dtype=np.int64)
    flat = np.concatenate(parts) if parts else np.empty(0)
    values = pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def sliced(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in smaller ones, so that what is built beside it stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a list column as numpy arrays, without a copy."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

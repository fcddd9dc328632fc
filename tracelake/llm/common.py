"""What several operators share: shared-folder tables, row identity and Arrow batch access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written

#: Stands for a null doc_id inside the operators; it sorts before every id.
NULL_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def key_of(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column without nulls, and the offsets of its rows in them."""
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row makes a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def key_chunks(batches: Iterator[pa.RecordBatch], key: str, rows: int = 60_000, size: int = 3 << 20, most: int = 250_000) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Regroups batches sorted by ``key`` so that no key is cut in two, but for those of more than ``most`` rows, which come in parts of
    about that many: each batch, and whether its first key began in the batch before."""
    held: list[pa.RecordBatch] = []
    open_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows and sum(b.nbytes for b in held) < size:
            continue
        now = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = longs(now.column(key))
        cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on
        if cut:
            yield now.slice(0, cut), keys[0] == open_key
            now, open_key = now.slice(cut), None
        if now.num_rows >= most:
            yield now, keys[-1] == open_key
            held, open_key = [], keys[-1]
        else:
            held = [now]
    if held:
        now = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield now, longs(now.column(key))[0] == open_key


def no_nulls(column: pa.Array, value) -> pa.Array:
    return pc.fill_null(column, value) if column.null_count else column

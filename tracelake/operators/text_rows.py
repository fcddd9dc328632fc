"""Rows made of texts by a plain function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

MOST_ROWS = 50_000


def once_a_text(queries: DataFrame, found: Callable[[str | None], list[tuple]], schema: str) -> DataFrame:
    """id and the columns of each row that ``found`` makes of the text, from the columns id and text.

    In a batch each text is read once, however many ids have it; the batches that go out have at most MOST_ROWS rows."""
    fields = StructType.fromDDL(schema).fields
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = ["id", *(f.name for f in fields)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").dictionary_encode(null_encoding="encode")
            rows, begins = [], [0]
            for text in texts.dictionary.to_pylist():
                rows += found(text)
                begins.append(len(rows))
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            codes, begins = texts.indices.to_numpy(), np.array(begins)
            ends = np.cumsum(np.diff(begins)[codes])  # by text of the batch: the rows up to it
            for a in range(0, int(ends[-1]) if len(ends) else 0, MOST_ROWS):
                at = np.arange(a, min(a + MOST_ROWS, ends[-1]))
                owner = np.searchsorted(ends, at, side="right")
                row = pa.array(begins[codes[owner] + 1] - ends[owner] + at)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), *(c.take(row) for c in columns)], names)

    return queries.mapInArrow(step, StructType([queries.schema["id"], *fields]))

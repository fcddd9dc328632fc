"""Results as CSV, TSV or JSON lines, written by Spark."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame

from .console import Result

SEPARATORS = {"csv": ",", "tsv": "\t"}


def export(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Quotes are doubled, nulls are empty."""
    if kind == "json":
        rows.write.json(path)
    else:
        rows.write.option("header", True).option("sep", SEPARATORS[kind]).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def document(result: Result, exported_at: datetime.datetime) -> str:
    """A report of the console as one JSON text: its columns, rows and when it was made."""
    return json.dumps({"columns": [c for c, _ in result.columns], "rows": result.rows, "exported_at": exported_at.isoformat()}, ensure_ascii=False)

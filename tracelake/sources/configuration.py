"""A platform configuration, dumped as one XML file per object, as the dictionary that operators.dictionary joins with."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionary import KINDS
from ..operators.metadata import WITH_ITEMS
from ..scratch import written

# The dump's element names, in the order of KINDS, and those of an object's members.
ELEMENTS = (
    "Catalog", "Document", "InformationRegister", "AccumulationRegister", "AccountingRegister", "CalculationRegister", "ChartOfCharacteristicTypes", "ChartOfAccounts", "ChartOfCalculationTypes", "Enum", "Constant",
    "DocumentJournal", "BusinessProcess", "Task", "ExchangePlan", "Sequence",
)
MEMBERS = {"Attribute": "attribute", "Dimension": "dimension", "Resource": "resource", "TabularSection": "tabular_section", "EnumValue": "enum_value"}
# Folders of the dump, in the order of KINDS; those of kinds with predefined items have a file with these.
FOLDERS = (
    "Catalogs", "Documents", "InformationRegisters", "AccumulationRegisters", "AccountingRegisters", "CalculationRegisters", "ChartsOfCharacteristicTypes", "ChartsOfAccounts", "ChartsOfCalculationTypes", "Enums", "Constants",
    "DocumentJournals", "BusinessProcesses", "Tasks", "ExchangePlans", "Sequences",
)
PREDEFINED = r"([^/]+)/([^/]+)/Ext/Predefined\.xml$"
ROWS = "kind string, name string, register_type string, section string, member_kind string, member string, ord int"


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _child(node, name: str):
    return next((c for c in node if _local(c) == name), None) if node is not None else None


def _property(node, name: str) -> str | None:
    found = _child(_child(node, "Properties"), name)
    return found.text if found is not None else None


def members_of(content: bytes) -> list[tuple]:
    """The rows of one file: the object itself, and each of its members. A file that isn't an object gives none."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return []
    node = next((c for c in root if _local(c) in ELEMENTS), None)
    if node is None or not _property(node, "Name"):
        return []
    head = (KINDS[ELEMENTS.index(_local(node))], _property(node, "Name"), _property(node, "RegisterType"))
    rows = [(*head, None, None, None, 0)]

    def add(parent, section: str | None) -> None:
        for i, c in enumerate(_child(parent, "ChildObjects") if _child(parent, "ChildObjects") is not None else (), 1):
            if _local(c) in MEMBERS and _property(c, "Name"):
                rows.append((*head, section, MEMBERS[_local(c)], _property(c, "Name"), i))
                if _local(c) == "TabularSection":
                    add(c, _property(c, "Name"))

    add(node, None)
    return rows


def predefined_of(path: str, content: bytes) -> list[tuple]:
    """The predefined items, nested ones too, of the object whose folder a file lies in."""
    found = re.search(PREDEFINED, path)
    kind = KINDS[FOLDERS.index(found[1])] if found and found[1] in FOLDERS else None
    if kind not in WITH_ITEMS:
        return []
    try:
        items = [c for c in ET.fromstring(content).iter() if _local(c) == "Item"]
    except ET.ParseError:
        return []
    names = [_child(c, "Name") for c in items]
    return [(kind, found[2], None, None, "predefined", n.text, i) for i, n in enumerate(names, 1) if n is not None and n.text]


#: Parts that the stored dictionary is written in; a change rewrites those of the files concerned.
BUCKETS = 64
#: Files that are read by their paths; of more, all are read and the others left out.
FEW_FILES = 10_000


def _files(spark: SparkSession, *roots: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(list(roots))


def refresh_configuration(spark: SparkSession, root: str, path: str) -> tuple[int, int]:
    """Brings the stored dictionary at ``path`` up to the dump below ``root``; returns how many files were parsed and how many are gone.

    The table has each file's path and a hash of its size and time. Only files that are new or differ are parsed, and only the
    parts of the table are rewritten that hold such files, or files that are gone."""
    bucket = F.pmod(F.xxhash64("file"), F.lit(BUCKETS)).cast("int").alias("bucket")
    now = written(_files(spark, root).select(F.col("path").alias("file"), F.xxhash64("length", "modificationTime").alias("stamp")).select("*", bucket))
    try:
        table = spark.read.parquet(path)
    except AnalysisException:  # there is none yet
        table = spark.createDataFrame([], f"{ROWS}, file string, stamp long, bucket int")
    known = table.where("kind IS NULL AND file IS NOT NULL").select("file", "stamp", "bucket")
    changed = written(now.join(known, ["file", "stamp"], "left_anti"))
    gone = written(known.join(now, "file", "left_anti"))
    parsed, lost = changed.count(), gone.count()
    if not parsed and not lost:
        return 0, 0
    touched = changed.select("bucket").union(gone.select("bucket")).distinct()
    stale = changed.select("file").union(gone.select("file"))
    kept = table.where("file IS NOT NULL").join(touched, "bucket", "left_semi").join(stale, "file", "left_anti")
    if parsed <= FEW_FILES:
        paths = [r.file for r in changed.select("file").collect()]
        content = _files(spark, *paths) if paths else _files(spark, root).limit(0)
    else:
        content = _files(spark, root).join(changed.select(F.col("file").alias("path")), "path", "left_semi")
    members = parsed_rows(content.select("path", "content")).join(changed, "file")
    none = {c: F.lit(None).cast(t) for c, t in (x.split() for x in ROWS.split(", "))}
    marks = changed.select(*(v.alias(c) for c, v in none.items()), "file", "stamp", "bucket")
    parts = touched.select(*(v.alias(c) for c, v in none.items()), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("stamp"), "bucket")
    columns = [*none, "file", "stamp", "bucket"]
    rows = written(kept.select(columns).unionByName(members.select(columns)).unionByName(marks).unionByName(parts))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return parsed, lost


def indexed_configuration(spark: SparkSession, root: str, path: str) -> DataFrame:
    """The dictionary as a table at ``path``, brought up to the dump first."""
    refresh_configuration(spark, root, path)
    return spark.read.schema(f"{ROWS}, file string, stamp long, bucket int").parquet(path).where("kind IS NOT NULL").select(*(x.split()[0] for x in ROWS.split(", ")))


def parsed_rows(files: DataFrame) -> DataFrame:
    """file, and the rows of each file (path, content)."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *r) for p, c in zip(batch["path"], batch["content"], strict=True) for r in (predefined_of if p.endswith("/Predefined.xml") else lambda _, x: members_of(x))(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["file", "kind", "name", "register_type", "section", "member_kind", "member", "ord"])

    return files.mapInPandas(step, f"file string, {ROWS}")


def read_configuration(spark: SparkSession, root: str) -> DataFrame:
    """One row per object (member null) and per member. Each file is small; Spark deals the files over tasks."""
    return parsed_rows(_files(spark, root).select("path", "content")).drop("file")

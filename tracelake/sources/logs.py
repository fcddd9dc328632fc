"""Application-server logs: folders ``<role>_<pid>/YYMMDDHH.log`` of multi-line ``key=value`` events, plain or zipped.

Files are read in splits of any size, so one huge file is many tasks. A first pass makes one row per split: how many events begin
in it, and the lines before its first header, which belong to the last event of a split before it. What is ordered per file is these
rows, not the lines. The second pass cuts each split into events and gets their numbers and missing tails from that table, by
broadcast if it is small (it is, but for files of very many splits), so no text is shuffled.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators.filters import micros
from ..scratch import written
from .log_bytes import heads, lines_in_any_encoding

HEADER = re.compile(r"(\d{1,2}):(\d{2})\.(\d{1,6})-(\d*),([^,\s]+),(\d+)(.*)", re.S)
BEGINS = re.compile(rb"\d{1,2}:\d{2}\.\d{1,6}-\d*,[^,\s]+,\d+")
SNIFFED, TRIED = 4096, 1 << 16
FIELD = re.compile(r""",([^=,]+)=('(?:[^']|'')*'|"(?:[^"]|"")*"|[^,]*)""", re.S)
FILE_NAME = r"(?i)^\d{8}\.log$"
ROLE = r"(?i)^(1cv8c|1cv8s|1cv8|ragent|rmngr|rphost)_(\d+)$"
# Event types with SQL, and the fields that have columns of their own.
ENGINES = {"DBMSSQL": "mssql", "DBPOSTGRS": "postgres"}
KNOWN = ("process", "p:processName", "t:clientID", "SessionID", "Sid", "Usr", "UserName", "Context", "Sql", "planSQLText", "Rows", "RowsAffected")
PIECES = "file string, block long, seq int, lines int, body binary"
SPLITS = "file string, block long, modified timestamp, last int, lines int, lead binary, is_log boolean, encoding string"
#: What the table of splits may hold to be broadcast: rows, and bytes of text.
FEW_SPLITS, FEW_BYTES = 1_000_000, 64 << 20
BOM = b"\xef\xbb\xbf"


def looks_like_log(head: bytes) -> bool:
    """Whether the first line that isn't empty begins as an event does."""
    lines = head[:SNIFFED].removeprefix(BOM).split(b"\n")
    first = next((x for x in (line.strip() for line in lines) if x), b"")
    return re.match(rb"\d{1,2}:\d{2}\.\d{1,6}-", first) is not None


def single_byte_encoding(lines: list[bytes]) -> str:
    """Of the lines that aren't UTF-8: the Windows code page, or the DOS one where they hold a byte that the other hasn't."""
    other = []
    for line in lines:
        try:
            line.decode("utf-8")
        except UnicodeDecodeError:
            other.append(line)
    return "cp866" if any(b"\x98" in line for line in other) else "cp1251"


def decoded(line: bytes, encoding: str = "cp1251") -> str:
    """UTF-8, or else the file's single-byte code page."""
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode(encoding, "replace")


def _by_split(batches: Iterator[pa.RecordBatch], columns: int):
    """(file, block, ...) and its lines, one batch at a time; a split may go on in the next batch."""
    for batch in batches:
        held, key = [], None
        for line, *at in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
            if at != key:
                if key:
                    yield key, held
                key, held = at, []
            held.append((line or b"").removeprefix(BOM).rstrip(b"\r"))
        if key:
            yield key, held


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split."""
    now, lead, n, lines, head = None, [], 0, 0, []

    def row():
        file, block, modified = now
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip((file, block, modified, n, lines, b"\n".join(lead), looks_like_log(b"\n".join(head)), single_byte_encoding(head)), TYPES, strict=True)],
            ["file", "block", "modified", "last", "lines", "lead", "is_log", "encoding"],
        )

    for key, part in _by_split(batches, 4):
        if key != now:
            if now:
                yield row()
            now, lead, n, lines, head = key, [], 0, 0, []
        begins = [bool(BEGINS.match(line)) for line in part]
        if n == 0:
            lead += part[: begins.index(True)] if any(begins) else part
        n += sum(begins)
        lines += len(part)
        size = sum(map(len, head))
        for line in part if size < TRIED else ():
            head.append(line)
            if (size := size + len(line)) >= TRIED:
                break
    if now:
        yield row()


TYPES = (pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.string())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The events of each split, without the lines before its first; lines is where an event starts."""
    key, body, seq, at, started = None, [], 0, 0, 0
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "block", "seq", "lines", "body"])

    for now, part in _by_split(batches, 3):
        done = []
        if now != key:
            if seq:
                done.append((*key, seq, started, b"\n".join(body)))
            key, body, seq, at, started = now, [], 0, 0, 0
        for line in part:
            if BEGINS.match(line):
                if seq:
                    done.append((*key, seq, started, b"\n".join(body)))
                body, seq, started = [], seq + 1, at
            body.append(line)
            at += 1
        if done:
            yield out(done)
    if seq:
        yield out([(*key, seq, started, b"\n".join(body))])


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["mm", "ss", "us", "duration_us", "event_type", "level"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int32()]
    for batch in batches:
        heads, maps = [], []
        for body, encoding in zip(batch.column("body").to_pylist(), batch.column("encoding").to_pylist(), strict=True):
            text = "\n".join(decoded(line, encoding) for line in body.split(b"\n"))
            mm, ss, us, took, kind, level, rest = HEADER.match(text).groups()
            heads.append((int(mm), int(ss), us.ljust(6, "0"), int(took) if took else None, kind, int(level)))
            found = {}
            for k, v in FIELD.findall(rest):
                quote = v[:1]
                found[k.strip()] = v[1:-1].replace(quote * 2, quote) if quote in ("'", '"') and len(v) > 1 and v.endswith(quote) else v
            maps.append(list(found.items()))
        columns = [pa.array(x, t) for x, t in zip(zip(*heads, strict=True) if heads else [()] * 6, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "file", "line", "modified")), *columns, pa.array(maps, pa.map_(pa.string(), pa.string()))], ["id", "file", "line", "modified", *names, "fields"])


def scanned_files(spark: SparkSession, root: str) -> DataFrame:
    """path, name, size, encoding, reason of the .log files below a folder: ``log``, or why a file is left out: its name (eight digits), or
    no log by its first line. Of each file only the beginning is read."""
    reason = F.when(~F.col("name").rlike(FILE_NAME), "other_name").when(F.col("is_log"), "log").otherwise("not_log")
    return heads(spark, root).where("size > 0").select("path", "name", "size", "encoding", reason.alias("reason"))


def log_files(spark: SparkSession, root: str) -> DataFrame:
    """path, name, size of the logs below a folder, small ones first."""
    return scanned_files(spark, root).where("reason = 'log'").drop("reason", "encoding").orderBy("size", "path")


def scan_stats(files: DataFrame) -> DataFrame:
    """How many files there are of each reason, and their sizes."""
    size = F.col("size").cast("double")
    return files.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("smallest"), F.max("size").alias("largest"), F.avg(size).alias("mean"), F.median(size).alias("median"))


def lines_of(spark: SparkSession, root: str) -> DataFrame:
    """value (binary), file, block, modified: the lines of the files that are logs by name, in the order of each split."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.log").option("lineSep", "\n").text(root)
    meta = F.col("_metadata")
    named = lines.select(F.col("value").cast("binary").alias("value"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_modification_time"].alias("modified"))
    return named.where(F.element_at(F.split("file", "/"), -1).rlike(FILE_NAME))


def zipped_lines(spark: SparkSession, root: str) -> DataFrame:
    """The same of the logs in zip files, each of which is one task; entries that point outside are left out."""
    kinds = [pa.binary(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, modified, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        parts = info.filename.replace("\\", "/").split("/")
                        if info.is_dir() or ".." in parts or parts[0] == "" or ":" in parts[0] or not re.search(FILE_NAME, parts[-1]):
                            continue
                        with z.open(info) as entry:
                            while lines := entry.readlines(4 << 20):
                                n = len(lines)
                                rows = ([x.rstrip(b"\n") for x in lines], [f"{path}/{'/'.join(parts)}"] * n, [0] * n, [modified] * n)
                                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], ["value", "file", "block", "modified"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    return files.select("path", "modificationTime", "content").mapInArrow(step, "value binary, file string, block long, modified timestamp")


def splits_of(lines: DataFrame) -> DataFrame:
    return lines.select("value", "file", "block", "modified").mapInArrow(_splits, SPLITS)


def raw_events(lines: DataFrame) -> DataFrame:
    """id, file, line, modified, encoding, body (binary) of each event. Files that aren't logs by their first line give none.

    Ids are consecutive over the files, small ones first; this orders one row per file."""
    per = splits_of(lines)
    order = Window.partitionBy("file").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    # The split whose last event goes on here: the latest one with a header.
    owner = F.last(F.when(F.col("last") > 0, F.col("block")), ignorenulls=True).over(upto)
    placed = per.withColumns({"owner": owner, "lines_before": F.coalesce(F.sum("lines").over(upto), F.lit(0)), "before": F.coalesce(F.sum("last").over(upto), F.lit(0))})
    first = F.min_by(F.struct("is_log", "encoding"), "block").alias("first")
    files = placed.groupBy("file").agg(F.sum("last").alias("n"), F.max("block").alias("size"), first).where("first.is_log")
    files = files.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("size", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "lead"))), lambda x: x["lead"])
    tails = placed.where("octet_length(lead) > 0 and owner is not null").groupBy("file", F.col("owner").alias("block")).agg(parts.alias("tail"))
    info = placed.select("file", "block", "modified", "last", "before", "lines_before").join(tails, ["file", "block"], "left").join(files.select("file", "offset", "first.encoding"), "file")
    info = written(info)
    size = info.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join(F.transform("tail", lambda x: F.hex(x)), "")) / 2), F.lit(0)).alias("bytes")).first()
    rows = lines.select("value", "file", "block").mapInArrow(_pieces, PIECES).join(F.broadcast(info) if size["n"] <= FEW_SPLITS and size["bytes"] <= FEW_BYTES else info, ["file", "block"])
    end = F.lit(b"\n")
    tail = F.aggregate("tail", F.col("body"), lambda body, part: F.concat(body, end, part))
    body = F.when((F.col("seq") == F.col("last")) & F.col("tail").isNotNull(), tail).otherwise(F.col("body"))
    return rows.select((F.col("offset") + F.col("before") + F.col("seq")).cast("long").alias("id"), "file", (F.col("lines_before") + F.col("lines") + 1).cast("int").alias("line"), "modified", "encoding", body.alias("body"))


def _first(fields: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(fields[n], F.lit("")) for n in names))


def interpreted(raw: DataFrame, archive: str) -> DataFrame:
    """The columns of ``events`` from raw events."""
    rows = raw.mapInArrow(_fields, "id long, file string, line int, modified timestamp, mm int, ss int, us string, duration_us long, event_type string, level int, fields map<string,string>")
    f, path = F.col("fields"), F.split("file", "/")
    folder = F.element_at(path, -2)
    # A name that isn't a time leaves the time of the file.
    hour = F.coalesce(tx.file_hour(F.element_at(path, -1)), F.date_trunc("hour", "modified").cast("timestamp_ntz"))
    at = F.coalesce(F.try_make_timestamp_ntz(F.year(hour), F.month(hour), F.dayofmonth(hour), F.hour(hour), F.col("mm"), F.concat("ss", F.lit("."), "us").cast("decimal(8,6)")), hour)
    db = F.col("event_type").isin(*ENGINES)
    sql = F.when(db, F.nullif(f["Sql"], F.lit("")))
    rest = F.map_filter(f, lambda k, v: ~k.isin(*KNOWN))
    out = rows.select(
        "id", F.lit(archive).alias("archive_id"), at.alias("ts"), "duration_us", "event_type", _first(f, "t:clientID", "SessionID", "Sid").try_cast("int").alias("session_id"), _first(f, "Usr", "UserName").alias("user_name"),
        f["Context"].alias("context"), tx.normalize_context(f["Context"]).alias("context_normalized"), _first(f, "process", "p:processName").alias("process"),
        F.when(folder.rlike(ROLE), F.lower(F.regexp_extract(folder, ROLE, 1))).otherwise("unknown").alias("process_role"), F.regexp_extract(folder, ROLE, 2).try_cast("int").alias("process_pid"),
        sql.alias("sql_text"), tx.normalize_sql(sql).alias("sql_text_normalized"), F.when(db, F.nullif(f["planSQLText"], F.lit(""))).alias("plan_text"),
        F.when(db, f["Rows"].try_cast("long")).alias("rows_read"), F.when(db, f["RowsAffected"].try_cast("long")).alias("rows_modified"),
        F.when(F.size(rest) > 0, F.to_json(rest)).alias("extra"), F.concat_ws("/", folder, F.element_at(path, -1)).alias("source_file"), F.col("line").alias("source_line_start"),
        F.when(F.col("event_type") == "DBMSSQL", "mssql").when(F.col("event_type") == "DBPOSTGRS", "postgres").alias("engine"),
    )
    return out.withColumn("sql_text_hash", tx.sql_hash(F.col("sql_text_normalized")))


def read_logs(spark: SparkSession, root: str, archive: str, zipped: bool = False) -> DataFrame:
    """The events of all log files below a folder, or in the zip files there. Runs a first pass over the texts.

    Files in UTF-16 or UTF-32 (by their first bytes) are read by whole code units; Spark's text reader would cut them anywhere."""
    if zipped:
        return interpreted(raw_events(zipped_lines(spark, root)), archive)
    lines = lines_of(spark, root)
    wide = [r.encoding for r in heads(spark, root).where("encoding LIKE 'utf-16%' OR encoding LIKE 'utf-32%'").select("encoding").distinct().collect()]  # four at most
    if wide:  # under another name: to the text reader these files are none that begin with an event
        lines = lines.unionByName(lines_in_any_encoding(spark, root, tuple(wide)).withColumn("file", F.concat(F.lit("wide:"), "file")))
    return interpreted(raw_events(lines), archive)


#: Columns of an archive that single values are looked up in.
LOOKED_UP = ("id", "sql_text_hash")


def write_archive(events: DataFrame, path: str) -> None:
    """One folder per archive: queries on one archive read only its files. Files hold ranges of time, in order, and the time in microseconds
    as ``ts_us`` (Spark's reader skips nothing by timestamps), so that ``filters.in_span`` reads few row groups; Bloom filters tell row
    groups that can't have an id or a statement's hash."""
    timed = events.withColumn("ts_us", micros(F.col("ts")))
    writer = timed.repartitionByRange("archive_id", "ts_us").sortWithinPartitions("archive_id", "ts_us").write.mode("append").partitionBy("archive_id")
    for column in LOOKED_UP:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.max.bytes", str(1 << 20)).parquet(path)


def rows_read(rows: DataFrame) -> dict[str, int]:
    """Runs a query of archives, and says how many files and rows its scans have read. Files and row groups that a filter rules out aren't among them."""
    execution = rows._jdf.queryExecution()
    execution.toRdd().count()
    todo, out = [execution.executedPlan()], {"files": 0, "rows": 0}
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        elif kind == "FileSourceScanExec":
            for name, metric in (("files", "numFiles"), ("rows", "numOutputRows")):
                out[name] += plan.metrics().apply(metric).value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return out


def archive_stats(spark: SparkSession, path: str) -> DataFrame:
    """archive_id, events, first and last time of each archive of a table, and the bytes of its files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    size = files.groupBy(F.regexp_extract("path", r"archive_id=([^/]+)/", 1).alias("archive_id")).agg(F.sum("length").alias("bytes"))
    events = spark.read.parquet(path).groupBy(F.col("archive_id").cast("string").alias("archive_id")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return events.join(size, "archive_id")


def with_files(archives: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """The registered archives (name, ...) and whether their folder is gone."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", r"archive_id=([^/]+)/", 1).alias("name")).where("name <> ''").distinct()
    return archives.join(there.withColumn("_there", F.lit(True)), "name", "left").withColumn("is_orphan", F.col("_there").isNull()).drop("_there")


def generated_lines(spark: SparkSession, events: int, files: int = 4, seed: int = 1) -> DataFrame:
    """file, line: sample logs of that many events each, the same for one seed; write them as text by file to make a folder of logs."""
    pick = lambda n, salt: F.pmod(F.xxhash64("id", "f", F.lit(seed * 100 + salt)), F.lit(n))
    kind = F.element_at(F.array(*map(F.lit, ("CALL", "DBMSSQL", "DBPOSTGRS", "EXCP", "TLOCK", "TDEADLOCK"))), (pick(6, 1) + 1).cast("int"))
    rows = spark.range(events).crossJoin(spark.range(files).withColumnRenamed("id", "f"))
    at = F.format_string("%02d:%02d.%06d-%d", F.floor(F.col("id") * 3600 / events / 60), F.floor(F.col("id") * 3600 / events % 60), pick(1_000_000, 2), pick(10_000_000, 3))
    sql = F.when(kind.startswith("DB"), F.concat(F.lit(",Sql='SELECT a FROM t WHERE id = "), pick(1000, 4).cast("string"), F.lit("'"))).otherwise("")
    line = F.concat(at, F.lit(","), kind, F.lit(",1,process=rphost,SessionID="), pick(50, 5).cast("string"), F.lit(",Context=Doc.Op"), pick(20, 6).cast("string"), F.lit(".Module : 1 : run"), sql)
    name = F.format_string("rphost_%d/2403150%d.log", F.col("f") + 1, F.col("f") % 10)
    return rows.select(name.alias("file"), "id", line.alias("line")).orderBy("file", "id").drop("id")

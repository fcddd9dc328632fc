"""Log files by their bytes: what encoding a file has, its lines in splits whatever the encoding, and growing files as a stream.

Three data sources, each read by path through Arrow's file systems (local, hdfs, s3, gs), so files of any size are many tasks:

* ``log_heads``: a row per .log file with its first bytes; nothing else of a file is read.
* ``log_lines``: lines as UTF-8 of files in any encoding. Splits begin at whole code units.
* ``log_tail``: a stream of whole events. The offset is a place in each file. An event is held back until the next one begins, or until
  its file has not grown for ``idle`` seconds; so what is appended late to an older file arrives once, and after a restart too.
"""

from __future__ import annotations

import codecs
import datetime
import io
import json
import re
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEAD = 1 << 16
CHUNK = 1 << 20
SPLIT = 64 << 20
FILES_A_TASK = 200
NAME = re.compile(r"\d{8}\.log\Z", re.I)
BEGINS = re.compile(rb"\d{1,2}:\d{2}\.\d{1,6}-\d*,[^,\s]+,\d+")
# Marks at the beginning of a file (the longer ones first), and the encodings that are tried without one, in order.
MARKS = [(b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
TRIED = ("utf-8", "cp1251", "cp866", "utf-16-le", "utf-16-be")
#: The share of control characters from which a decoded text is taken for another encoding's.
ODD, LOOKED_AT = 0.2, 2000


def detect_encoding(head: bytes) -> str:
    """The encoding that a file's first bytes tell: by their mark; else the first one tried that decodes them to a text with Cyrillic
    letters and few control characters; else the first that decodes them at all; else UTF-8. A character may be cut at the end."""
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    possible = None
    for name in TRIED:
        try:
            text = codecs.getincrementaldecoder(name)().decode(head, final=len(head) < HEAD)
        except UnicodeDecodeError:
            continue
        possible = possible or name
        shown = text[:LOOKED_AT]
        if re.search("[Ѐ-ӿ]", text) and sum(c < " " and c not in "\n\r\t" for c in shown) < ODD * len(shown):
            return name
    return possible or "utf-8"


def unit_of(encoding: str) -> int:
    """Bytes of a code unit."""
    return 2 if encoding.startswith("utf-16") else 4 if encoding.startswith("utf-32") else 1


def first_line(head: bytes, encoding: str) -> str:
    text = codecs.getincrementaldecoder(encoding)("replace").decode(head[: len(head) // unit_of(encoding) * unit_of(encoding)])
    return next((x for x in (line.strip() for line in text.removeprefix("﻿").split("\n")) if x), "")


def is_log(head: bytes, encoding: str) -> bool:
    """Whether the first line that isn't empty begins as an event does."""
    return re.match(r"\d{1,2}:\d{2}\.\d{1,6}-", first_line(head[: 4096 * unit_of(encoding)], encoding)) is not None


@dataclass
class File:
    path: str
    size: int
    modified: float


class Folder:
    """The .log files below a path."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.scheme = ""
        if re.match(r"file:/+", root):
            root, self.scheme = re.sub(r"^file:/+", "/", root), "file://"
        if re.match(r"\w+://", root):
            self.fs, self.root = fs.FileSystem.from_uri(root)
            self.scheme = root[: root.index("://") + 3] if not self.root.startswith("/") else root[: len(root) - len(self.root)]
        else:
            self.fs, self.root, self.scheme = fs.LocalFileSystem(), root, "file://"

    def files(self) -> list[File]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        rows = [File(f.path, f.size, f.mtime_ns / 1e9 if f.mtime_ns else 0.0) for f in found if f.is_file and f.path.lower().endswith(".log")]
        return sorted(rows, key=lambda f: f.path)

    def open(self, path: str, at: int = 0) -> io.BufferedReader:
        out = io.BufferedReader(self.fs.open_input_file(path), CHUNK)
        out.seek(at)
        return out

    def head(self, path: str, size: int = HEAD) -> bytes:
        with self.open(path) as f:
            return f.read(size)


def line_ends(data: bytes, encoding: str) -> list[int]:
    """Where lines end in bytes that begin at a whole code unit: behind each line feed."""
    unit = unit_of(encoding)
    kind = {1: "u1", 2: "<u2", 4: "<u4"}[unit]
    units = np.frombuffer(data, kind if not encoding.endswith("-be") else kind.replace("<", ">"), len(data) // unit)
    return ((np.flatnonzero(units == 0x0A) + 1) * unit).tolist()


def lines(file: io.BufferedReader, start: int, stop: int, encoding: str) -> Iterator[tuple[int, bytes]]:
    """(offset, line in UTF-8 without its end) of the lines that begin in [start, stop), to their ends; ``start`` is a whole code unit. The
    first line is left out if it began before ``start``."""
    unit, back = unit_of(encoding), 0
    if start:
        back = unit  # the unit before tells whether a line begins here
    file.seek(start - back)
    held, at, inside = b"", start - back, not start
    while True:
        chunk = file.read(CHUNK)
        held += chunk
        whole = len(held) // unit * unit
        a = 0
        for z in line_ends(held[:whole], encoding):
            if inside:
                if at + a >= stop:
                    return
                yield at + a, utf8(held[a:z], encoding)
            inside, a = True, z
        held, at = held[a:], at + a
        if inside and at >= stop:
            return
        if not chunk:
            if inside and held:
                yield at, utf8(held, encoding)
            return


def utf8(line: bytes, encoding: str) -> bytes:
    """A line's bytes as UTF-8, without its end and a mark before it. A line of a file in a single-byte encoding may be UTF-8 already."""
    if unit_of(encoding) > 1:
        return line.decode(encoding, "replace").removeprefix("﻿").rstrip("\r\n").encode("utf-8", "replace")
    line = line.removeprefix(b"\xef\xbb\xbf").rstrip(b"\r\n")
    try:
        line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode(encoding if encoding in ("cp1251", "cp866") else "cp1251", "replace").encode()
    return line


@dataclass
class Part(InputPartition):
    paths: list
    start: int = 0
    stop: int = 0
    modified: float = 0.0


def _moment(seconds: float) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc)


TIME = pa.timestamp("us", tz="UTC")


class HeadReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> Sequence[InputPartition]:
        files = Folder(self.root).files()
        return [Part([(f.path, f.size, f.modified) for f in files[i : i + FILES_A_TASK]]) for i in range(0, len(files), FILES_A_TASK)] or [Part([])]

    def read(self, partition: Part):
        folder = Folder(self.root)
        for path, size, modified in partition.paths:
            head = folder.head(path)
            encoding = detect_encoding(head)
            yield (folder.scheme + path, path.rsplit("/", 1)[-1], size, _moment(modified), encoding, is_log(head, encoding))


class LogHeads(DataSource):
    """path, name, size, modified, encoding, is_log of each .log file below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "log_heads"

    def schema(self) -> str:
        return "path string, name string, size long, modified timestamp, encoding string, is_log boolean"

    def reader(self, schema) -> DataSourceReader:
        return HeadReader(self.options["path"])


def parts_of(path: str, start: int, stop: int, unit: int, split: int, modified: float) -> list[Part]:
    step = max(unit, split // unit * unit)
    return [Part([path], a, min(a + step, stop), modified) for a in range(start, stop, step)]


class LineReader(DataSourceReader):
    def __init__(self, root: str, split: int, encodings: set[str] | None):
        self.root, self.split, self.encodings = root, split, encodings

    def partitions(self) -> Sequence[InputPartition]:
        folder, out = Folder(self.root), []
        for f in folder.files():
            if NAME.search(f.path.rsplit("/", 1)[-1]):
                encoding = detect_encoding(folder.head(f.path))
                if self.encodings is None or encoding in self.encodings:
                    out += parts_of(f.path, 0, f.size, unit_of(encoding), self.split, f.modified)
        return out or [Part([])]

    def read(self, partition: Part):
        folder = Folder(self.root)
        for path in partition.paths:
            encoding = detect_encoding(folder.head(path))
            with folder.open(path) as f:
                yield from _batches(((line, folder.scheme + path, partition.start, _moment(partition.modified)) for _, line in lines(f, partition.start, partition.stop, encoding)), ("value", "file", "block", "modified"), (pa.binary(), pa.string(), pa.int64(), TIME))


def _batches(rows: Iterator[tuple], names: tuple, kinds: tuple, most: int = 10_000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, held_size = [], 0
    for row in rows:
        held.append(row)
        held_size += len(row[0])
        if len(held) >= most or held_size >= size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], list(names))
            held, held_size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], list(names))


class LogLines(DataSource):
    """value (UTF-8), file, block, modified: the lines of the files that are logs by name. Options: path, split (bytes), encodings (comma-separated; all without it)."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "value binary, file string, block long, modified timestamp"

    def reader(self, schema) -> DataSourceReader:
        chosen = self.options.get("encodings")
        return LineReader(self.options["path"], int(self.options.get("split", SPLIT)), set(chosen.split(",")) if chosen else None)


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str, split: int, idle: float, checkpoint: str | None):
        self.root, self.split, self.idle, self.checkpoint = root, split, idle, checkpoint
        self.reached: dict[str, int] | None = None  # how far each file has been read; never goes back
        self.seen: dict[str, tuple[int, str, int]] = {}  # path: size when last looked at, encoding, and how far its whole events reach

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        folder, out, now = Folder(self.root), {}, time.time()
        if self.reached is None:
            self.reached = last_offsets(self.checkpoint) if self.checkpoint else {}
        for f in folder.files():
            if not NAME.search(f.path.rsplit("/", 1)[-1]) or not f.size:
                continue
            size, encoding, upto = self.seen.get(f.path, (-1, "", 0))
            if size != f.size:
                head = folder.head(f.path)
                encoding = detect_encoding(head)
                upto = last_begin(folder, f.path, f.size, encoding, upto) if is_log(head, encoding) else 0
                self.seen[f.path] = (f.size, encoding, upto)
            at = f.size // unit_of(encoding) * unit_of(encoding) if upto and now - f.modified >= self.idle else upto - 1
            at = max(at, self.reached.get(f.path, 0))
            if at > 0:
                out[f.path] = self.reached[f.path] = at
        return self.reached | out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        folder, out = Folder(self.root), []
        for path, stop in end.items():
            if (begin := start.get(path, 0)) < stop:
                info = folder.fs.get_file_info(path)
                unit = unit_of(detect_encoding(folder.head(path)))
                for part in parts_of(path, begin, stop, unit, self.split, info.mtime_ns / 1e9 if info.mtime_ns else 0.0):
                    part.paths = [path, stop]
                    out.append(part)
        return out or [Part([])]

    def read(self, partition: Part):
        if not partition.paths:
            return
        path, end = partition.paths
        folder = Folder(self.root)
        encoding = detect_encoding(folder.head(path))
        yield from _batches(
            ((body, folder.scheme + path, at, _moment(partition.modified)) for at, body in events(folder, path, partition.start, partition.stop, end, encoding)), ("body", "file", "offset", "modified"), (pa.binary(), pa.string(), pa.int64(), TIME)
        )


def last_offsets(checkpoint: str) -> dict[str, int]:
    """The offsets that a stream last planned, from its checkpoint: with them a restarted source knows what it has passed on."""
    from pyarrow import fs

    folder = Folder(checkpoint)
    found = folder.fs.get_file_info(fs.FileSelector(f"{folder.root}/offsets", allow_not_found=True))
    numbers = [int(f.base_name) for f in found if f.base_name.isdigit()]
    if not numbers:
        return {}
    with folder.open(f"{folder.root}/offsets/{max(numbers)}") as f:
        rows = f.read().decode().splitlines()
    return next((d for d in (json.loads(x) for x in rows[2:] if x.startswith("{")) if all(isinstance(v, int) for v in d.values())), {})


def last_begin(folder: Folder, path: str, size: int, encoding: str, known: int = 0) -> int:
    """1 + where the last event of a file begins, looked for from its end; 0 if none does."""
    unit, stop, span = unit_of(encoding), size, HEAD
    floor = max(0, known - 1)
    while stop > floor:
        start = max(floor, (stop - span) // unit * unit)
        found = None
        with folder.open(path) as f:
            for at, line in lines(f, start, stop, encoding):
                if BEGINS.match(line):
                    found = at
        if found is not None:
            return found + 1
        stop, span = start, span * 4
    return known


def events(folder: Folder, path: str, start: int, stop: int, end: int, encoding: str) -> Iterator[tuple[int, bytes]]:
    """(offset, body) of the events that begin in [start, stop); the last one reaches to the next one's beginning, or to ``end``."""
    now, body = -1, []
    with folder.open(path) as f:
        for at, line in lines(f, start, end, encoding):
            if BEGINS.match(line):
                if now >= 0:
                    yield now, b"\n".join(body)
                if at >= stop:
                    return
                now, body = at, [line]
            elif now >= 0:
                body.append(line)
            elif at >= stop:
                return
    if now >= 0:
        yield now, b"\n".join(body)


class LogTail(DataSource):
    """body (UTF-8), file, offset, modified of each event of growing log files below ``path``. Options: path, split (bytes), idle (seconds), checkpoint
    (the query's, so that a restarted source knows what it has passed on)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "body binary, file string, offset long, modified timestamp"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options["path"], int(self.options.get("split", SPLIT)), float(self.options.get("idle", 60)), self.options.get("checkpoint"))


def register(spark: SparkSession) -> None:
    for source in (LogHeads, LogLines, LogTail):
        spark.dataSource.register(source)


def heads(spark: SparkSession, root: str) -> DataFrame:
    register(spark)
    return spark.read.format("log_heads").load(root)


def lines_in_any_encoding(spark: SparkSession, root: str, encodings: tuple[str, ...] = (), split: int = SPLIT) -> DataFrame:
    """The lines of the logs below a folder, of those in certain encodings if some are named."""
    register(spark)
    reader = spark.read.format("log_lines").option("split", split)
    return (reader.option("encodings", ",".join(encodings)) if encodings else reader).load(root)


def tail(spark: SparkSession, root: str, checkpoint: str, idle: float = 60, split: int = SPLIT) -> DataFrame:
    """A stream of the events of the log files below a folder, also of those that files get later. Files may only grow: lines that go on an
    event which was passed on already, as its file had not grown for ``idle`` seconds, are left out."""
    register(spark)
    return spark.readStream.format("log_tail").option("idle", idle).option("split", split).option("checkpoint", checkpoint).load(root)

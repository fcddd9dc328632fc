import datetime
import json
import os
import random
import threading
import time
import zipfile

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from tracelake.functions import text as tx
from tracelake.operators import filters, rules, usage
from tracelake.plans.views import log_events
from tracelake.sources import log_bytes, logs
from tracelake.sources.console import Rejected, TimedOut, check, console, report
from tracelake.sources.export import document, export
from tracelake.streaming import follow

DATA = "/root/testdata/sf0.001"
LOG = """00:01.123456-1500,DBMSSQL,3,process=rphost,t:clientID=17,Usr=ann,Sql='SELECT ''x'', a
FROM t
WHERE b = 12',Rows=5,RowsAffected=,Context=Doc.Sale.Module : 12 : run
00:02.5-,CALL,1,SessionID=x9,Context="two ""quoted"", parts",Memory=7
59:59.000001-10,NEWTYPE,0
99:02.5-1,CALL,1
"""


def put(folder, name, text, encoding="utf-8-sig"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))


def test_read_logs(spark, tmp_path):
    put(tmp_path / "rphost_12", "24031507.log", LOG)
    put(tmp_path / "other", "24031508.log", "00:01.1-1,EXCP,0,Descr='Ошибка'\r\n", "cp1251")
    put(tmp_path / "other", "notes.log", LOG)
    put(tmp_path / "other", "24031509.log", "", "utf-8")
    put(tmp_path / "other", "24031510.log", "junk before the first header\n" + LOG)
    files = logs.scanned_files(spark, str(tmp_path))
    assert {(r.name, r.reason) for r in files.collect()} == {("24031507.log", "log"), ("24031508.log", "log"), ("notes.log", "other_name"), ("24031510.log", "not_log")}
    assert {r.reason: r.n for r in logs.scan_stats(files).collect()}["log"] == 2 and [r.name for r in logs.log_files(spark, str(tmp_path)).collect()] == ["24031508.log", "24031507.log"]
    got = logs.read_logs(spark, str(tmp_path), "A").orderBy("source_file", "source_line_start").collect()
    assert [r.event_type for r in got] == ["EXCP", "DBMSSQL", "CALL", "NEWTYPE", "CALL"]
    assert json.loads(got[0].extra) == {"Descr": "Ошибка"} and got[0].process_role == "unknown" and got[0].process_pid is None
    sql = got[1]
    assert sql.sql_text == "SELECT 'x', a\nFROM t\nWHERE b = 12" and sql.sql_text_normalized == "SELECT ?, a FROM t WHERE b = ?"
    assert (sql.ts, sql.duration_us, sql.session_id, sql.rows_read, sql.rows_modified, sql.context_normalized, sql.process_role, sql.process_pid, sql.source_line_start) == (
        datetime.datetime(2024, 3, 15, 7, 0, 1, 123456), 1500, 17, 5, None, "Doc.Sale.Module", "rphost", 12, 1,
    )
    assert got[2].context == 'two "quoted", parts' and got[2].session_id is None and got[2].duration_us is None
    assert got[4].ts == datetime.datetime(2024, 3, 15, 7) and len({r.id for r in got}) == 5


def test_code_pages_and_file_times(spark, tmp_path):
    put(tmp_path / "a", "24031508.log", "00:01.1-1,EXCP,0,Descr='Шина'\n", "cp866")
    put(tmp_path / "b", "24031508.log", "00:01.1-1,EXCP,0,Descr='Шина'\n", "utf-8")
    put(tmp_path / "c", "24139999.log", "00:01.1-1,EXCP,0,Descr='x'\n")
    os.utime(tmp_path / "c" / "24139999.log", (1_700_000_000, 1_700_000_000))
    got = {r.source_file: r for r in logs.read_logs(spark, str(tmp_path), "A").collect()}
    assert json.loads(got["a/24031508.log"].extra) == json.loads(got["b/24031508.log"].extra) == {"Descr": "Шина"}
    assert got["c/24139999.log"].ts == datetime.datetime(2023, 11, 14, 22, 0, 1, 100000)


def test_zipped_logs(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("rphost_12/24031507.log", LOG)
        z.writestr("../24031507.log", LOG)
        z.writestr("/abs/24031507.log", LOG)
        z.writestr("notes.txt", LOG)
    put(tmp_path / "plain" / "rphost_12", "24031507.log", LOG, "utf-8")
    zipped, plain = logs.read_logs(spark, str(tmp_path), "A", zipped=True).collect(), logs.read_logs(spark, str(tmp_path / "plain"), "A").collect()
    assert sorted(zipped, key=lambda r: r.id) == sorted(plain, key=lambda r: r.id) and len(plain) == 4


def test_generated_logs(spark, tmp_path):
    lines = logs.generated_lines(spark, 200, 2).collect()
    assert lines == logs.generated_lines(spark, 200, 2).collect() and len(lines) == 400
    for file in {r.file for r in lines}:
        put(tmp_path / file.split("/")[0], file.split("/")[1], "".join(r.line + "\n" for r in lines if r.file == file))
    got = logs.read_logs(spark, str(tmp_path), "A")
    assert got.count() == 400 and got.where("sql_text is not null and engine is not null").count() == sum("Sql=" in r.line for r in lines)
    logs.write_archive(got, str(tmp_path / "w"))
    known = spark.createDataFrame([("A",), ("B",)], "name string")
    assert {(r.name, r.is_orphan) for r in logs.with_files(known, spark, str(tmp_path / "w")).collect()} == {("A", False), ("B", True)}


def test_splits_give_the_same_events(spark, tmp_path):
    body = "".join(f"{i % 60:02d}:00.{i:06d}-{i},CALL,1,Context='c{i}\nmore {'x' * (i % 50)}\nlines'\n" for i in range(2000))
    put(tmp_path / "rmngr_1", "24031507.log", body)
    whole = logs.read_logs(spark, str(tmp_path), "A").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        parts = logs.read_logs(spark, str(tmp_path), "A").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(whole) == 2000 and sorted(whole, key=lambda r: r.id) == sorted(parts, key=lambda r: r.id)


def test_archives_and_exports(spark, tmp_path):
    e = log_events(spark, DATA)
    logs.write_archive(e, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).where("archive_id = 'A'").count() == e.where("archive_id = 'A'").count()
    export(spark.createDataFrame([('a "q", b', None)], "x string, y string").coalesce(1), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_text() == 'x,y\n"a ""q"", b",\n'


@pytest.mark.parametrize("sql", [
    "DROP TABLE events", "INSERT INTO events SELECT 1", "SELECT * FROM parquet.`/etc`", "SELECT reflect('java.lang.System', 'exit', 1) FROM events", "SELECT TRANSFORM(a) USING 'cat' FROM events", "SET a = 1",
    "WITH other AS (SELECT * FROM other) SELECT * FROM other", "WITH a AS (SELECT 1), b AS (WITH c AS (SELECT * FROM c) SELECT * FROM c) SELECT * FROM b", "SELECT * FROM other", "SELECT (SELECT max(x) FROM other) FROM events", "SELECT '--' ; DROP TABLE events", "CACHE TABLE events",
])
def test_console_rejects(spark, sql):
    with pytest.raises(Exception) as e:
        check(spark, sql, {"events"})
    assert isinstance(e.value, Rejected) or "PARSE" in str(e.value).upper()


@pytest.mark.parametrize("sql", [
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')",
    "SELECT id, max(id) OVER w FROM events WINDOW w AS (ORDER BY reflect('java.lang.System', 'getProperty', 'user.home'))",
    "SELECT id, max(id) OVER w FROM events WINDOW w AS (ORDER BY (SELECT max(id) FROM other))",
    "SELECT * FROM IDENTIFIER('other')", "SELECT mine(id) FROM events", "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT `try_reflect`('java.lang.System', 'getProperty', 'user.home')",
    "SELECT id FROM events ORDER BY java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT transform(array(1), x -> reflect('java.lang.System', 'getProperty', 'user.home'))",
    "SELECT id FROM events WHERE id IN (SELECT id FROM other)", "SELECT * FROM range(1000000000000)", "SELECT * FROM events LATERAL VIEW explode(array(reflect('java.lang.System', 'getProperty', 'user.home'))) x AS y",
    "WITH a AS (SELECT id FROM other) SELECT * FROM a", "SELECT * FROM events PIVOT (max(reflect('java.lang.System', 'getProperty', 'user.home')) FOR id IN (1, 2))",
])
def test_console_runs_nothing_else(spark, sql):
    spark.range(3).createOrReplaceTempView("other")
    spark.udf.register("mine", lambda x: x, "long")
    with pytest.raises((Rejected, ParseException)):
        console(spark, sql, {"events": spark.range(30).toDF("id")})


def test_console_ends_in_time(spark):
    events = spark.range(20_000, numPartitions=2).toDF("id")
    slow = "SELECT count(*) AS n FROM events a JOIN events b ON sha2(cast(a.id AS string), 512) <> sha2(cast(b.id AS string), 512) JOIN events c ON a.id + b.id <> c.id"
    others: list = []
    beside = threading.Thread(target=lambda: others.append(spark.range(2_000_000).selectExpr("max(sha2(cast(id AS string), 512))").count()))
    beside.start()
    began = time.monotonic()
    with pytest.raises(TimedOut):
        report(spark, slow, {"events": events}, seconds=2)
    assert time.monotonic() - began < 30
    beside.join()
    assert others == [1]
    assert report(spark, "SELECT max(id) AS n FROM events", {"events": events}, seconds=60).rows == [[19_999]]
    with pytest.raises(Exception, match="DIVIDE"):  # other errors stay what they are
        report(spark, "SELECT 1 / (id - id) FROM events", {"events": events}, seconds=60)


def test_console(spark):
    e = spark.range(30).toDF("id")
    assert console(spark, "WITH a AS (SELECT id FROM events) SELECT count(*) AS n FROM a WHERE id > (SELECT avg(id) FROM events)", {"events": e}).first().n == 15
    assert console(spark, "SELECT * FROM events", {"events": e}, 5).count() == 5
    assert console(spark, "WITH a AS (SELECT id FROM events), b AS (SELECT * FROM a) SELECT max(id) AS n FROM b WHERE id < :top", {"events": e}, args={"top": 7}).first().n == 6
    assert console(spark, "SELECT count(*) AS n FROM events WHERE id > ?", {"events": e}, args=[27]).first().n == 2
    assert console(spark, "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT max(n) AS n FROM r", {"events": e}).first().n == 4
    part, whole = report(spark, "SELECT id, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS t, array(1.5BD) AS a FROM events ORDER BY id", {"events": e}, 29), report(spark, "SELECT id FROM events", {"events": e}, 30)
    assert part.truncated and len(part.rows) == 29 and part.rows[0] == [0, "2024-01-02T03:04:05", ["1.5"]] and part.columns[0] == ("id", "bigint") and not whole.truncated


def test_stream(spark, tmp_path):
    e = log_events(spark, DATA)
    e.write.parquet(str(tmp_path / "in"))
    out = follow.lock_counts(follow.follow(spark, str(tmp_path / "in"), e.schema))
    q = out.writeStream.format("memory").queryName("locks").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("locks").selectExpr("sum(locks) + sum(deadlocks) AS n").first().n == e.where("event_type in ('TLOCK', 'TDEADLOCK')").count()


def test_log_stream(spark, tmp_path):
    run = lambda: follow.follow_logs(spark, str(tmp_path / "in"), "A", str(tmp_path / "w"), str(tmp_path / "c"), idle=0).trigger(availableNow=True).start().awaitTermination(120)
    put(tmp_path / "in" / "rphost_12", "24031507.log", LOG)
    run()
    put(tmp_path / "in" / "rphost_12", "24031508.log", LOG)
    run()
    got = spark.read.parquet(str(tmp_path / "w"))
    assert got.count() == 8 and got.select("id").distinct().count() == 8 and got.where("process_role = 'rphost'").count() == 8
    batch = logs.read_logs(spark, str(tmp_path / "in"), "A").drop("id", "source_line_start")
    assert sorted(map(str, got.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))


@pytest.mark.parametrize("encoding", ["utf-8", "cp1251", "utf-16-le", "utf-16-be"])
def test_growing_files_arrive_once(spark, tmp_path, encoding):
    """Lines are appended in pieces that cut events, over restarts and to an older file; each whole event arrives once."""
    file = tmp_path / "in" / "rphost_1" / "24031507.log"
    file.parent.mkdir(parents=True)
    written = [f"{n % 60:02d}:00.{n:06d}-1,CALL,1,Usr=имя{n},Context='a\nline {n}\n{'x' * n * 7}'\n" for n in range(40)]
    data = "".join(written).encode(encoding)
    if encoding.startswith("utf-16"):
        data = "\ufeff".encode(encoding) + data
    cuts = [0, 7, 300, 1001, 1002, len(data) // 3, len(data) // 2 + 1, len(data) - 11, len(data)]

    def run(idle):
        follow.follow_logs(spark, str(tmp_path / "in"), "A", str(tmp_path / "w"), str(tmp_path / "c"), idle, split=700).trigger(availableNow=True).start().awaitTermination(120)

    for n, (a, z) in enumerate(zip(cuts, cuts[1:])):
        with file.open("ab") as f:
            f.write(data[a:z])
        if n in (2, 3, 4, 6, 7):
            run(3600)
    assert sorted(x.user_name for x in spark.read.parquet(str(tmp_path / "w")).collect()) == sorted(f"имя{n}" for n in range(39))
    run(0)  # has not grown: the last event too
    late = "59:59.000001-1,CALL,1,Usr=late,Context=b\n"
    with file.open("ab") as f:
        f.write(("goes on an event that was passed on\n" + late).encode(encoding))
    run(3600)
    run(0)
    run(0)
    got = spark.read.parquet(str(tmp_path / "w")).collect()
    assert sorted(x.user_name for x in got) == sorted([*(f"имя{n}" for n in range(40)), "late"]) and len({x.id for x in got}) == 41
    assert {x.user_name: x.context for x in got}["имя9"] == f"a\nline 9\n{'x' * 63}"


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be", "cp1251", "cp866"])
def test_encodings(spark, tmp_path, encoding, monkeypatch):
    text = LOG.replace("ann", "Шань") + "".join(f"10:{n:02d}.000001-1,CALL,1,Usr=u{n},Context=Ъ{n}\n" for n in range(60))
    mark = "\ufeff" if encoding.startswith("utf") else ""
    put(tmp_path / "in" / "rphost_1", "24031507.log", mark + text, encoding)
    put(tmp_path / "in" / "rphost_2", "24031508.log", text)
    monkeypatch.setattr(log_bytes, "SPLIT", 99)
    got = {}
    for r in logs.read_logs(spark, str(tmp_path / "in"), "A").collect():
        got.setdefault(r.process_pid, []).append((r.ts.minute, r.ts.second, r.ts.microsecond, r.event_type, r.user_name, r.context, r.sql_text, r.source_line_start, r.source_file[-4:]))
    assert len(got[1]) == 64 and sorted(got[1]) == sorted(got[2])


def test_encoding_by_first_bytes():
    phrase = "47:02.139004-1,CALL,1,Context='Документ.Реализация.МодульОбъекта'\n"
    detect = log_bytes.detect_encoding
    assert [detect(phrase.encode(e)) for e in ("utf-8", "utf-8-sig", "cp1251")] == ["utf-8", "utf-8-sig", "cp1251"]
    assert detect(b"\xff\xfe" + phrase.encode("utf-16-le")) == "utf-16-le" and detect(b"\xfe\xff" + phrase.encode("utf-16-be")) == "utf-16-be"
    assert detect(b"\xff\xfe\0\0" + phrase.encode("utf-32-le")) == "utf-32-le" and detect(b"\0\0\xfe\xff" + phrase.encode("utf-32-be")) == "utf-32-be"
    assert detect(b"") == "utf-8" and detect(b"plain\n") == "utf-8" and detect(b"\x98\x8f") == "cp866"
    assert detect(phrase.encode("utf-16-le")) == "utf-16-le"  # without a mark: control characters tell
    long = (phrase * 2000).encode()[: log_bytes.HEAD]
    assert detect(long[:-1] if (long[-1] & 0xC0) == 0x80 else long) == "utf-8"  # a character is cut at the end


def test_only_heads_are_read(spark, tmp_path, monkeypatch):
    put(tmp_path / "a_1", "24031507.log", LOG)
    put(tmp_path / "a_1", "24031508.log", "no log\n")
    put(tmp_path / "a_1", "other.log", LOG)
    big = tmp_path / "a_1" / "24031509.log"
    with big.open("wb") as f:
        f.write(LOG.encode())
        f.truncate(3 << 30)  # a hole: reading all of it would take long
    began = time.monotonic()
    got = {r.name: (r.reason, r.size) for r in logs.scanned_files(spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 20
    assert got["24031509.log"] == ("log", 3 << 30) and got["24031508.log"][0] == "not_log" and got["other.log"][0] == "other_name" and got["24031507.log"][0] == "log"


def test_interval_join(spark, tmp_path):
    e = log_events(spark, DATA)
    e.write.parquet(str(tmp_path / "in"))
    side = lambda *types: follow.follow(spark, str(tmp_path / "in"), e.schema).where(F.col("event_type").isin(*types))
    q = follow.calls_with_locks(side("CALL"), side("TLOCK"), 86_400, "30 days").writeStream.format("memory").queryName("near").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = e.select("id", "ts", "session_id", "event_type").collect()
    day = datetime.timedelta(days=1)
    want = {(a.id, b.id) for a in rows if a.event_type == "CALL" for b in rows if b.event_type == "TLOCK" and a.session_id == b.session_id and a.ts - day <= b.ts <= a.ts}
    assert want and {(r.call_id, r.lock_id) for r in spark.table("near").collect()} == want


def judged(rows, per_hour=10, cooldown=300):
    held, out = {}, []
    for key, item, at in rows:
        mine = held[key] = [(t, i) for t, i in held.get(key, ()) if t > at - 3600]
        reason = "per_item" if any(i == item and t > at - cooldown for t, i in mine) else "per_key" if len(mine) >= per_hour else None
        if reason is None:
            mine.append((at, item))
        out.append((key, item, at, reason is None, reason))
    return out


def run_stream(df, name, path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).start()
    return q


def test_admission(spark, tmp_path):
    """Batch after batch: the verdicts are those of the whole history, and keys that are idle hold no state."""
    follow.with_state(spark)
    one = [("k", f"i{n % 3}", 10 + n * 60) for n in range(40)] + [("other", "i", 10 + n * 200) for n in range(12)]
    two = [("k", f"i{n % 5}", 2400 + n * 30) for n in range(60)] + [("third", "x", 3000)]
    three = [("late", "i", 40_000), ("late", "i", 40_100)]
    rows = [one, two, three, [("late", "i", 60_000)], [("end", "i", 90_000)]]
    (tmp_path / "in").mkdir()
    schema = "key string, item string, at long"
    q = run_stream(follow.admitted(spark.readStream.schema(schema).json(str(tmp_path / "in"))), "admitted", tmp_path / "c")
    held = []
    for n, batch in enumerate(rows):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("key", "item", "at"), r))) for r in batch))
        q.processAllAvailable()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    want = judged(sorted(one, key=lambda r: r[2]) + sorted(two, key=lambda r: r[2]) + three + rows[3] + rows[4])
    got = [tuple(r) for r in spark.table("admitted").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {r[4] for r in want} == {None, "per_item", "per_key"}
    assert held[1] == 3 and held[-1] == 1  # the others were idle for an hour


def test_sessions_of_a_stream(spark, tmp_path):
    """Events out of order, batch after batch, some so late that they join two sessions: the sessions of the whole table."""
    r, start = random.Random(3), datetime.datetime(2024, 1, 1)
    rows = [(r.randint(1, 6), start + datetime.timedelta(minutes=m + r.randint(-40, 0)), r.choice(["CALL", "EXCP", "EXCPCNTX"]), r.randint(1, 99)) for m in sorted(r.randint(0, 3000) for _ in range(500))]
    rows += [(None, start, "CALL", 1)]
    schema = "session_id int, ts timestamp, event_type string, duration_us long"
    table = spark.createDataFrame(rows, schema)
    (tmp_path / "in").mkdir()
    q = run_stream(follow.sessions(spark.readStream.schema(schema).json(str(tmp_path / "in")), "20 minutes", "2 hours"), "sessions", tmp_path / "c")
    for n in range(0, len(rows), 90):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"session_id": i, "ts": t.isoformat(), "event_type": e, "duration_us": u}) for i, t, e, u in rows[n : n + 90]))
        q.processAllAvailable()
    (tmp_path / "in" / "end.json").write_text(json.dumps({"session_id": 99, "ts": "2025-01-01T00:00:00", "event_type": "CALL", "duration_us": 1}))
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, follow.sessions(table, "20 minutes").collect()))
    assert spark.table("sessions").count() > 20


def test_edges(spark):
    none = log_events(spark, DATA).limit(0)
    from tracelake.operators import anatomy, compare, views

    assert views.slow_queries(none).count() == 0 and views.duration_histogram(none).count() == 7 and not anatomy.operation_summary(none).first().found
    assert compare.regressions(compare.load_operations(none), compare.load_operations(none)).count() == 0
    assert usage.islands(spark.createDataFrame([(1, 0, 5), (1, 5, 6), (1, 4, 9), (2, 1, 2)], "k int, s long, e long"), ["k"], "s", "e").count() == 2
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "SELECT 1")], "id int, text string")
    assert rules.sql_findings(texts, "postgres").count() == 0 and rules.query_findings(texts).count() == 0
    assert filters.by_context(none, "with").count() == 0


def test_configuration(spark, tmp_path):
    from tracelake.operators import dictionary
    from tracelake.sources.configuration import read_configuration

    ns = 'xmlns="http://example.org/md"'
    put(tmp_path / "Catalogs", "a.xml", f"<MetaDataObject {ns}><Catalog><Properties><Name>Товары</Name></Properties><ChildObjects><Attribute><Properties><Name>Цена</Name></Properties></Attribute>"
        "<TabularSection><Properties><Name>Цены</Name></Properties><ChildObjects><Attribute><Properties><Name>Дата</Name></Properties></Attribute></ChildObjects></TabularSection></ChildObjects></Catalog></MetaDataObject>")  # fmt: skip
    put(tmp_path / "Enums", "b.xml", f"<MetaDataObject {ns}><Enum><Properties><Name>Виды</Name></Properties><ChildObjects><EnumValue><Properties><Name>Опт</Name></Properties></EnumValue></ChildObjects></Enum></MetaDataObject>")
    put(tmp_path, "bad.xml", "<oops")
    rows = read_configuration(spark, str(tmp_path))
    assert {(r.kind, r.name, r.section, r.member_kind, r.member) for r in rows.collect()} == {
        ("Справочник", "Товары", None, None, None), ("Справочник", "Товары", None, "attribute", "Цена"), ("Справочник", "Товары", None, "tabular_section", "Цены"),
        ("Справочник", "Товары", "Цены", "attribute", "Дата"), ("Перечисление", "Виды", None, None, None), ("Перечисление", "Виды", None, "enum_value", "Опт"),
    }
    refs = dictionary.references(spark.createDataFrame([(1, "Перечисление.Виды.Опт, Перечисление.Виды.Розница, Справочник.Услуги")], "id int, text string"))
    assert [r.member for r in dictionary.missing_members(refs, rows.where("member is not null")).collect()] == ["Розница"]
    assert [r.name for r in dictionary.missing_objects(refs, rows).collect()] == ["Услуги"]


def test_predefined_items_and_index(spark, tmp_path):
    from tracelake.sources.configuration import indexed_configuration, read_configuration

    item = lambda name, more="": f"<Item><Name>{name}</Name>{more}</Item>"
    nested = item("Группа", f"<ChildItems>{item('Внутри')}</ChildItems>")
    put(tmp_path / "in" / "Catalogs" / "Товары" / "Ext", "Predefined.xml", f"<PredefinedData xmlns='http://example.org/p'>{item('Основной')}{nested}</PredefinedData>", "utf-8")
    put(tmp_path / "in" / "Documents" / "Счет" / "Ext", "Predefined.xml", f"<PredefinedData>{item('Нет')}</PredefinedData>", "utf-8")
    rows = read_configuration(spark, str(tmp_path / "in")).collect()
    assert {(r.kind, r.name, r.member_kind, r.member) for r in rows} == {("Справочник", "Товары", "predefined", m) for m in ("Основной", "Группа", "Внутри")}
    table = lambda: {r.member for r in indexed_configuration(spark, str(tmp_path / "in"), str(tmp_path / "w")).collect()}
    assert table() == {"Основной", "Группа", "Внутри"}
    made = sorted(f.name for f in (tmp_path / "w").rglob("part*"))
    assert table() and sorted(f.name for f in (tmp_path / "w").rglob("part*")) == made  # not made anew
    put(tmp_path / "in" / "Catalogs" / "Услуги" / "Ext", "Predefined.xml", f"<PredefinedData>{item('Другой')}</PredefinedData>", "utf-8")
    assert "Другой" in table()


def test_index_parses_what_has_changed(spark, tmp_path):
    from tracelake.sources.configuration import indexed_configuration, read_configuration, refresh_configuration

    catalog = lambda name, field: f"<MetaDataObject><Catalog><Properties><Name>{name}</Name></Properties><ChildObjects><Attribute><Properties><Name>{field}</Name></Properties></Attribute></ChildObjects></Catalog></MetaDataObject>"
    root, at = tmp_path / "in", str(tmp_path / "w")
    for n in range(150):
        put(root / "Catalogs", f"c{n}.xml", catalog(f"К{n}", "Цена"), "utf-8")
    put(root, "bad.xml", "<oops", "utf-8")
    refresh = lambda: refresh_configuration(spark, str(root), at)
    same = lambda: sorted(map(str, indexed_configuration(spark, str(root), at).collect())) == sorted(map(str, read_configuration(spark, str(root)).collect()))
    assert refresh() == (151, 0) and same() and refresh() == (0, 0)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "w").rglob("part*")}
    put(root / "Catalogs", "c7.xml", catalog("К7", "НоваяЦена"), "utf-8")
    assert refresh() == (1, 0) and same()
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "w").rglob("part*")}
    assert len({f.parent for f in before.keys() ^ after.keys()}) == 1  # one part was rewritten
    (root / "Catalogs" / "c9.xml").unlink()
    put(root / "Catalogs", "new.xml", catalog("Новый", "Вес"), "utf-8")
    assert refresh() == (1, 1) and same()
    for f in (root / "Catalogs").iterdir():
        f.unlink()
    assert refresh() == (0, 150) and same() and indexed_configuration(spark, str(root), at).count() == 0


def test_archives_are_pruned(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("id", "if(id % 2 = 0, 'A', 'B') AS archive_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, pmod(id * 7919, 200000)) AS ts", "md5(string(id % 50000)) AS sql_text_hash").repartition(8)
    block = spark.sparkContext._jsc.hadoopConfiguration()
    block.set("parquet.block.size", str(64 << 10))
    block.set("parquet.page.size", str(8 << 10))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        logs.write_archive(rows, str(tmp_path / "w"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        block.unset("parquet.block.size")
        block.unset("parquet.page.size")
    table = spark.read.parquet(str(tmp_path / "w"))
    assert sorted(map(tuple, table.select("id", "sql_text_hash").collect())) == sorted(map(tuple, rows.select("id", "sql_text_hash").collect()))
    whole = logs.rows_read(table.selectExpr("max(id)"))
    one = logs.rows_read(table.where("archive_id = 'A'").selectExpr("max(id)"))
    hour = filters.in_span(table.where("archive_id = 'A'"), None, datetime.datetime(2024, 1, 1, 1))
    span = logs.rows_read(hour.selectExpr("max(id)"))
    assert hour.count() == filters.in_span(rows, datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1, 1)).where("archive_id = 'A'").count() == 1800
    single = logs.rows_read(table.where("id = 123456").selectExpr("max(ts)"))
    assert whole["rows"] == 200_000 and one["rows"] == 100_000 and one["files"] < whole["files"]
    assert span["rows"] < 20_000 and 0 < single["rows"] < 100_000
    assert table.where("id = 123456").count() == 1 and table.where("sql_text_hash = md5('77')").count() == 4


def test_archive_stats_and_documents(spark, tmp_path):
    e = log_events(spark, DATA)
    logs.write_archive(e, str(tmp_path / "w"))
    got = {r.archive_id: r for r in logs.archive_stats(spark, str(tmp_path / "w")).collect()}
    assert got["A"].events == e.where("archive_id = 'A'").count() and got["B"].bytes > 0 and got["A"].first < got["B"].last
    said = json.loads(document(report(spark, "SELECT 1 AS a, 'x' AS b", {}), datetime.datetime(2024, 1, 2)))
    assert said == {"columns": ["a", "b"], "rows": [[1, "x"]], "exported_at": "2024-01-02T00:00:00"}


def test_rule_files(spark):
    text = """---
id: slow_one
applies_to: operation
priority: 70
patterns:
  - field: calls
    operator: ">="
    value: 10
  - field: kind
    operator: in
    value: [a, "b c"]
---
# Title: {{calls}}
"""
    (rule,) = rules.rules_from([text, "no block here"])
    assert rule == ("slow_one", "operation", 70, [("calls", ">=", 10), ("kind", "in", ["a", "b c"])])
    rows = spark.createDataFrame([(1, 10, "a"), (2, 9, "a"), (3, 50, "b c"), (4, 50, None)], "id int, calls int, kind string")
    assert [r.id for r in rules.explained(rows, rules=[rule]).where("explanation = 'slow_one'").orderBy("id").collect()] == [1, 3]
    assert rules.explained(rows.drop("kind"), rules=[rule]).where("explanation is not null").count() == 0


def test_quantiles_and_windows_of_null_keys(spark):
    from tracelake.operators.compare import exact_quantiles

    rows = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9, 4)] + [("b", 7)], "k string, v long")
    counts = rows.groupBy("k", "v").count()
    assert {r.k: (r.p, r.q) for r in exact_quantiles(counts, "k", "v", "count", {"p": 0.5, "q": 0.9}).collect()} == {"a": (4.0, 7.4), "b": (7.0, 7.0)}
    at = datetime.datetime(2024, 1, 1, 0, 30)
    events = spark.createDataFrame([(1, 7, at), (2, 7, at + datetime.timedelta(minutes=59)), (3, 7, at + datetime.timedelta(minutes=61)), (4, None, at), (5, None, at)], "id long, session_id int, ts timestamp_ntz")
    assert {r.id: r.in_the_hour for r in usage.hour_load(events).collect()} == {1: 1, 2: 2, 3: 2, 4: None, 5: None}


def test_plan_texts(spark):
    from tracelake.functions.plan_texts import canonical_json_plan, canonical_numbered_plan, canonical_xml_plan

    rows = spark.createDataFrame([('<p b="1" a="2" ActualRows="9"/>', '[{"Plan": {"b": 1, "Actual Rows": 2, "a": {"Buffers": 1}}}]', "1> Scan (cost 0.123456)\n2>  Seek"), ("<p", "{", None), (None, None, "")], "x string, j string, n string")
    got = rows.select(canonical_xml_plan("x").alias("x"), canonical_json_plan("j").alias("j"), canonical_numbered_plan("n").alias("n")).collect()
    assert list(map(tuple, got)) == [('<p a="2" b="1"></p>', '[{"Plan":{"a":{},"b":1}}]', "Scan (cost 0.123) Seek"), ("<p", "{", None), (None, None, "")]


def test_dialect_leaves_the_rest():
    from tracelake.sources.dialect import to_spark

    for text in ("SELECT 'arg_max(a, b) QUALIFY 1.0 / 2' AS \"arg_max\" -- x::varchar\nFROM t", "SELECT a.arg_max(1), b FROM t /* ASOF JOIN u ON 1 */", "SELECT 'open", "SELECT max(a) FROM t"):
        assert to_spark(text) == text
    assert to_spark("select arg_max(a, quantile_cont(b, .5)) from t") == "select max_by(a, percentile(b, .5)) from t"
    assert to_spark("SELECT * FROM t ASOF JOIN u ON t.a + 1 >= u.a") == "SELECT * FROM t ASOF JOIN u ON t.a + 1 >= u.a"  # Spark says that it can't

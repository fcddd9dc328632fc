"""What is done once though many rows need it, and which row is taken of several that are equal."""

import re

import duckdb

from tracelake.functions import plan_lines
from tracelake.operators import dictionary
from tracelake.sources.console import console


def test_names_are_matched_once(spark):
    wrong = spark.range(50).selectExpr("id", "'K' AS kind", "if(id = 7, null, 'Stok') AS name")
    known = spark.createDataFrame([("K", n) for n in ("Stock", "Stack", "Stokk", "stok", "Store", "Stob", "Stokes", "Other")], "kind string, name string")
    out = dictionary.suggestions(wrong, known, most_names=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    probes = re.split(r"Generate explode\(.*array_distinct|Generate explode\(\[\[", plan)[1]
    assert "id#" not in re.search(r"Aggregate \[([^\]]*)\]", probes)[1]
    want = [("Stob", 1), ("Stock", 1), ("Stokk", 1), ("Stack", 2)]
    assert sorted(map(tuple, out.collect())) == sorted((i, "K", "Stok", *w) for i in range(50) if i != 7 for w in want)


def test_plan_lines_are_matched_once(spark):
    lines = ["Hash Joined  (x)", "Hash Join", "  ->  Hash  (rows=1)", "    ->Index Only Scan using i", "Index Scanner", "Index Scan_", "SortКлюч", "Bitmap", "", "  -> ", "\tGather Merge (a)", "Aggregate", "-> ->Sort"]
    plans = spark.createDataFrame([(1, "\r\n".join(lines)), (2, None)], "id long, plan_text string")
    told = plan_lines.annotated(plans)
    filtered = plan_lines.parents(told)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp_replace(_line" in line or "lambdafunction" in line for line in filtered.split("\n") if "Filter" in line)
    nodes = [(r.n, r.name, r.depth) for r in told.where("kind = 'node'").orderBy("n").collect()]
    assert nodes == [(1, "Hash", 0), (2, "Hash Join", 0), (3, "Hash", 6), (4, "Index Only Scan", 6), (7, "Sort", 0), (11, "Gather Merge", 1), (12, "Aggregate", 0)]
    assert told.count() == len(lines)


def test_first_of_equal_rows_is_taken(spark, tmp_path):
    """As DuckDB does it: of rows with the same value the first in the table, and none whose argument is null."""
    rows = "SELECT i * 7919 % 1000 AS id, i % 9 AS g, CASE WHEN i % 5 = 0 THEN NULL WHEN i % 11 = 0 THEN 'nan'::DOUBLE WHEN i % 13 = 0 THEN -0.0 ELSE (i % 4)::DOUBLE END AS v, CASE WHEN i % 3 > 0 THEN 'n' || i % 50 END AS name FROM range(1000) t(i)"
    con, path = duckdb.connect(), str(tmp_path / "t.parquet")
    con.execute(f"COPY ({rows}) TO '{path}'")
    con.execute(f"SET threads = 1; CREATE VIEW t AS SELECT * FROM '{path}'")
    tables = {"t": spark.read.parquet(path)}
    for sql in (
        "SELECT g, arg_max(id, v) AS a, arg_min(id, v) AS b, arg_max(name, v) AS c, argmin(name || '!', v + 1) AS d, count(*) AS n FROM t GROUP BY g",
        "SELECT max_by(x.id, x.v) FILTER (WHERE x.g > 3) AS a, min_by(id, name) AS b FROM (SELECT * FROM t WHERE v < 3) x",
        "SELECT DISTINCT g, arg_max(name, v) OVER (PARTITION BY g) AS a FROM t",
        "SELECT g, arg_max(g, sum(id)) OVER () AS a FROM t GROUP BY g",
    ):
        assert sorted(map(tuple, console(spark, sql, tables, dialect="duckdb").collect())) == sorted(con.execute(sql).fetchall()), sql
    assert console(spark, "SELECT *, arg_max(id, id) OVER (PARTITION BY g) AS a FROM t", tables, dialect="duckdb").columns == ["id", "g", "v", "name", "a"]

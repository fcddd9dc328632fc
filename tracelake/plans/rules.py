"""Queries of the rules and of the explanations. Each event of the test table has one of some shapes of statement, by its id, so
that every rule goes over a whole table; what must be found in a shape is said beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import EV, log_events
from ..operators import anatomy as an
from ..operators import rules as ru
from ..operators import usage as us
from ..operators import views as vi

#: Statements in the platform's query language ({n} is the event's number), and for each finding its rule and what it covers.
QUERY_SHAPES = [
    ("ВЫБРАТЬ * ИЗ Справочник.Товары КАК Т{n}", [("select_star", "ВЫБРАТЬ *")]),
    ("ВЫБРАТЬ А ИЗ Т КАК Т ГДЕ А В (ВЫБРАТЬ Б ИЗ Д ГДЕ Б = {n})", [("in_with_subquery", "В (ВЫБРАТЬ")]),
    ("ВЫБРАТЬ А\r\nИЗ Т КАК Т\r\nГДЕ НЕ В (ВЫБРАТЬ Б ИЗ Д) И А = {n}", [("in_with_subquery", "В (ВЫБРАТЬ"), ("not_in_with_subquery", "НЕ В (ВЫБРАТЬ")]),
    ("ВЫБРАТЬ А ИЗ Т КАК Т, Д КАК Д{n}", [("comma_join_implicit", "ИЗ Т КАК Т, Д КАК Д{n}")]),
    ("ВЫБРАТЬ А\nИЗ Т КАК Т\n ГДЕ ПОДСТРОКА(А, 1, 2) = 1\n  ИЛИ Б = {n}", [("function_in_where", "ГДЕ ПОДСТРОКА("), ("or_in_where", "ГДЕ ПОДСТРОКА(А, 1, 2) = 1\n  ИЛИ")]),
    ("ВЫБРАТЬ ПЕРВЫЕ 10 А ИЗ Т{n}", [("pervye_without_order", "ВЫБРАТЬ ПЕРВЫЕ 10")]),
    ("ВЫБРАТЬ ПЕРВЫЕ 10 А ИЗ Т УПОРЯДОЧИТЬ ПО А{n}", []),
    ("ВЫБРАТЬ РАЗЛИЧНЫЕ А ИЗ Т\nОБЪЕДИНИТЬ ВЫБРАТЬ Б ИЗ Д{n}", [("select_distinct", "ВЫБРАТЬ РАЗЛИЧНЫЕ"), ("union_without_all", "ОБЪЕДИНИТЬ ")]),
    ("ВЫБРАТЬ А ИЗ Т ОБЪЕДИНИТЬ ВСЕ ВЫБРАТЬ Б ИЗ Д{n}", []),
    ("SELECT a FROM t LEFT JOIN (SELECT b FROM d) x{n}", [("subquery_in_join", "JOIN (SELECT")]),
    ("ВЫБРАТЬ А ПОМЕСТИТЬ ВТ{n} ИЗ Т;", [("temp_table_without_index", "ПОМЕСТИТЬ ВТ{n} ИЗ Т;")]),
    ("ВЫБРАТЬ А ПОМЕСТИТЬ ВТ ИЗ Т ИНДЕКСИРОВАТЬ ПО А{n};", []),
    ("ВЫБРАТЬ А ИЗ Т КАК Т ЛЕВОЕ СОЕДИНЕНИЕ РегистрНакопления.Р{n}.Остатки() КАК О", [("virtual_table_in_join", "СОЕДИНЕНИЕ РегистрНакопления.Р{n}.Остатки(")]),
    ("ВЫБРАТЬ А ИЗ Т КАК Т ГДЕ ВЫРАЗИТЬ(А КАК Справочник.Т) = {n}", [("vyrazit_in_where", "ГДЕ ВЫРАЗИТЬ(")]),
    ("select top 5 a from t where upper(a) = 'x' or b in (select c from d)", [("pervye_without_order", "select top 5"), ("function_in_where", "where upper("), ("or_in_where", "where upper(a) = 'x' or"), ("in_with_subquery", "in (select")]),
    ("ВЫБРАТЬ А, Б ИЗ Т КАК Т ВНУТРЕННЕЕ СОЕДИНЕНИЕ Д КАК Д ПО А = Б ГДЕ А = {n}", []),
    ("SELECT DISTINCT * FROM t AS t{n}", [("select_distinct", "SELECT DISTINCT")]),
    ("ВЫБРАТЬ * ИЗ Т; ВЫБРАТЬ * ИЗ Д{n}", [("select_star", "ВЫБРАТЬ *"), ("select_star", "ВЫБРАТЬ *")]),
]
MANY = ", ".join(map(str, range(100)))
#: Statements of the database engines: for each finding its rule and severity.
SQL_SHAPES = {
    "mssql": [
        ("SELECT a FROM t WHERE a NOT IN (SELECT b FROM d WHERE c = {n})", [("not_in_with_subquery", "Major")]),
        ("SELECT a FROM t WHERE a IN (SELECT b FROM d) AND c = {n}", []),
        ("SELECT TOP 10 * FROM t WHERE a = 1 OR b = {n}", [("or_in_where", "Major"), ("select_star", "Minor")]),
        ("SELECT a FROM t WHERE CASE WHEN a = 1 OR b = 2 THEN 1 END = {n}", []),
        ("SELECT a FROM t WHERE iif(a = 1 OR b = 2, 1, 0) = {n}", []),
        ("SELECT a FROM t WHERE c = 1 AND (a = 1 OR b = {n})", [("or_in_where", "Major")]),
        ("SELECT a FROM t WHERE UPPER(a) = 'X{n}'", [("function_on_column", "Major")]),
        ("SELECT a FROM t WHERE YEAR(t.d) = {n} GROUP BY a", [("function_on_column", "Major")]),
        ("SELECT UPPER(a) FROM t WHERE a = {n}", []),
        ("SELECT a FROM t WHERE b = DATEADD(1, 2, 3) AND c = {n}", []),
        ("SELECT a FROM t WHERE a LIKE '%x{n}'", [("leading_wildcard_like", "Major")]),
        ("SELECT a FROM t WHERE a LIKE N'x%{n}'", []),
        ("SELECT a FROM t CROSS JOIN d WHERE a = {n}", [("cross_join", "Critical")]),
        ("SELECT a FROM t WHERE b IN (" + MANY + ")", [("large_in_list", "Major")]),
        ("SELECT a FROM t WHERE b IN (1, 2, {n})", []),
        ("SELECT t.a FROM t LEFT JOIN d AS x ON x.id = t.id WHERE x.b = {n}", [("left_join_filtered", "Major")]),
        ("SELECT t.a FROM t LEFT OUTER JOIN d x ON x.id = t.id WHERE x.b IS NULL AND t.a = {n}", []),
        ("SELECT t.a FROM t LEFT JOIN d x ON x.id = t.id WHERE t.b = {n}", []),
        ("SELECT a FROM t WHERE a = 'this OR that' -- OR b {n}", []),
        ("SELECT count(*) FROM t /* SELECT * */ WHERE a = {n}", []),
        ("SELECT t.a FROM t LEFT JOIN u ON t.id = u.id WHERE u.x = {n}", [("left_join_filtered", "Major")]),
        ("SELECT t.a FROM t LEFT JOIN dbo.[u] ON t.id = u.id WHERE [u].x = {n}", [("left_join_filtered", "Major")]),
        ("SELECT t.a FROM t LEFT JOIN (SELECT b FROM c) AS x ON x.b = t.a WHERE x.b > {n}", [("left_join_filtered", "Major")]),
        ("SELECT a FROM (SELECT t.a FROM t LEFT JOIN u ON u.i = t.i) q WHERE u.b > {n}", []),
        ("SELECT t.a FROM t RIGHT JOIN u ON u.i = t.i WHERE u.b > {n}", []),
        ("SELECT [OR] FROM t WHERE [OR] = {n}", []),
        ("SELECT a FROM t WHERE CASE WHEN (a = 1 OR b = 2) THEN 1 END = {n}", []),
        ("SELECT a FROM t WHERE iif((a = 1 OR b = 2), 1, 0) = {n}", []),
        ("SELECT a FROM t WHERE iif(c = 3 AND (a = 1 OR b = 2), 1, 0) = {n}", [("or_in_where", "Major")]),
        ("SELECT a FROM t WHERE b = '-- no comment' OR c = {n}", [("or_in_where", "Major")]),
        ("SELECT a FROM t WHERE b = {n} -- 'x\nOR c = 2", [("or_in_where", "Major")]),
        ("SELECT TOP 5 PERCENT * FROM t WHERE a = {n}", [("select_star", "Minor")]),
        ("SELECT TOP (5) WITH TIES * FROM t ORDER BY a", [("select_star", "Minor")]),
        ("SELECT a, * FROM t WHERE b = {n}", [("select_star", "Minor")]),
        ("SELECT a * b, t.* FROM t WHERE EXISTS (SELECT * FROM u)", [("select_star", "Minor")]),
        ("SELECT a FROM t WHERE LEFT(a, 3) = 'x{n}'", [("function_on_column", "Major")]),
        ("SELECT a FROM t WHERE b = CONVERT(varchar(10), @p1) AND c = UPPER('x{n}')", []),
        ("SELECT a FROM t WHERE d > DATEADD(day, {n}, @p1)", []),
        ("SELECT a FROM t WHERE d > COALESCE(1, (b))", [("function_on_column", "Major")]),
        ("SELECT 'abc {n}", [("parse_error", "Info")]),
        ("SELECT (a FROM t WHERE b = {n}", [("parse_error", "Info")]),
    ],
    "postgres": [
        ("SELECT a FROM t ORDER BY a OFFSET 7", [("offset_without_limit", "Warning")]),
        ("SELECT a FROM (SELECT b FROM d LIMIT 3) x OFFSET 5", [("offset_without_limit", "Warning")]),
        ("SELECT a FROM t ORDER BY a LIMIT 5 OFFSET 20000", [("large_offset_pagination", "Critical")]),
        ("SELECT a FROM t ORDER BY a LIMIT 5 OFFSET 1000", [("large_offset_pagination", "Warning")]),
        ("SELECT a FROM t WHERE c = {n} LIMIT 5 OFFSET 999", []),
        ("SELECT a FROM t WHERE a ILIKE 'x%'", [("ilike_without_trgm", "Warning")]),
        ("SELECT a FROM t WHERE a ILIKE 'x{n}'", []),
        ("SELECT a FROM t WHERE a LIKE '%x{n}'", [("like_with_leading_wildcard", "Warning")]),
        ("SELECT a FROM _Reference12 WHERE a LIKE '%x{n}'", [("like_with_leading_wildcard", "Info")]),
        ("SELECT a FROM t WHERE a NOT IN (SELECT b FROM d)", [("not_in_with_subquery_pg", "Warning")]),
        ("SELECT a FROM t WHERE c @> x", [("jsonb_without_gin", "Info")]),
        ("SELECT a FROM t WHERE a::text = b", [("cast_in_where_predicate", "Warning")]),
        ("SELECT a FROM t WHERE upper(a) = 'x{n}'", [("cast_in_where_predicate", "Warning")]),
        ("SELECT a FROM t WHERE date_trunc('day', d) = '2024'", [("cast_in_where_predicate", "Warning")]),
        ("SELECT a FROM _Reference1 WHERE a::mvarchar = b", []),
        ("SELECT a FROM t WHERE b = 'x'::text AND c > {n}", []),
        ("SELECT a FROM t UNION SELECT b FROM d", [("union_instead_of_union_all", "Info")]),
        ("SELECT a FROM t UNION ALL SELECT b FROM d", []),
        ("SELECT DISTINCT a FROM t JOIN d ON a = b", [("distinct_on_large_result", "Info")]),
        ("SELECT DISTINCT a FROM t WHERE b IN (SELECT x FROM y JOIN z ON x = w)", []),
        ("SELECT a FROM t WHERE user_id = '12'", [("implicit_type_cast", "Warning")]),
        ("SELECT a FROM t WHERE '12' = t.version_no", [("implicit_type_cast", "Warning")]),
        ("SELECT a FROM t WHERE name = '12'", []),
        ("SELECT * FROM t JOIN d ON a = b", [("select_star_with_join", "Info")]),
        ("SELECT * FROM t WHERE EXISTS (SELECT 1 FROM x JOIN d ON a = b)", []),
        ("SELECT * FROM _Document3 JOIN d ON a = b", []),
        ("SELECT a FROM t ORDER BY random()", [("order_by_random_with_limit", "Critical")]),
        ("SELECT a FROM t ORDER BY random() LIMIT 1", [("order_by_random_with_limit", "Warning")]),
        ("DELETE FROM t", [("missing_where_on_update_delete", "Critical")]),
        ("UPDATE t SET a = {n}", [("missing_where_on_update_delete", "Critical")]),
        ("DELETE FROM t WHERE a = {n}", []),
        ("SELECT a, (SELECT max(d.b) FROM d WHERE d.k = t.k) AS m FROM t", [("subquery_in_select_list", "Warning")]),
        ("SELECT a, (SELECT max(b) FROM d) AS m FROM t", []),
        ("SELECT a FROM _InfoRg5 WHERE a::mchar = b::text", [("mchar_vs_text_comparison", "Warning"), ("cast_in_where_predicate", "Warning")]),
        ("SELECT a FROM _InfoRg5 WHERE a::mchar = b::mvarchar(10)", []),
        ("UPDATE t SET a = (SELECT max(b) FROM u WHERE u.id = {n})", [("missing_where_on_update_delete", "Critical")]),
        ("WITH x AS (SELECT {n}) DELETE FROM t", [("missing_where_on_update_delete", "Critical")]),
        ("WITH x AS (DELETE FROM t RETURNING *) SELECT a FROM x WHERE a > {n}", [("missing_where_on_update_delete", "Critical")]),
        ("DELETE FROM t; SELECT a FROM u WHERE b = {n}", [("missing_where_on_update_delete", "Critical")]),
        ("WITH x AS (SELECT {n}) UPDATE t SET a = 1 WHERE b IN (SELECT c FROM x)", []),
        ("SELECT a FROM t WHERE b = {n} FOR UPDATE", []),
        ("INSERT INTO t (a) VALUES ({n}) ON CONFLICT (a) DO UPDATE SET b = 2", []),
        ("SELECT id FROM t WHERE data -> 'k{n}' = '1'", [("jsonb_without_gin", "Info")]),
        ("SELECT 'a -> b' FROM t WHERE c = {n}", []),
        ("SELECT a FROM t WHERE a IS DISTINCT FROM {n} AND lower(c) = 'x'", [("cast_in_where_predicate", "Warning")]),
        ("SELECT extract(year FROM d) FROM t WHERE b = {n}", []),
        ("SELECT a FROM t WHERE extract(year FROM d) = {n}", [("cast_in_where_predicate", "Warning")]),
        ("SELECT a FROM t WHERE x IN (SELECT b FROM d UNION SELECT c FROM e WHERE f = {n})", [("union_instead_of_union_all", "Info")]),
        ("SELECT a FROM t UNION ALL (SELECT b FROM d) ORDER BY random() LIMIT {n}", [("order_by_random_with_limit", "Warning")]),
        ("SELECT $$ it's ( $$, $q$ WHERE $q$ FROM t WHERE a = {n}", []),
        ("SELECT E'it\\'s' FROM t WHERE a = {n}", []),
        ("SELECT a FROM t WHERE b = E'\\' AND c = {n}", [("parse_error", "Info")]),
        ("SELECT a /* {n} /* inner */ still */ FROM t", []),
        ("SELECT a FROM t WHERE a::varchar = _fld1::mchar", [("cast_in_where_predicate", "Warning"), ("mchar_vs_text_comparison", "Warning")]),
        ("SELECT \"select\" FROM \"update\" WHERE \"or\" = {n}", []),
    ],
}
#: Where a rule's finding is: the part of the statement that it covers.
PLACED = {
    "mssql": [
        ("SELECT a\nFROM t\r\nWHERE b NOT IN (SELECT c FROM d) AND e = {n}", [("not_in_with_subquery", "NOT IN (SELECT")]),
        ("SELECT t.a FROM t\n LEFT JOIN u ON t.i = u.i\n WHERE u.x = {n}", [("left_join_filtered", "u.x")]),
        ("/* ' */ SELECT a FROM t WHERE a = 1 -- '\n  OR b = 2 OR c = {n}", [("or_in_where", "OR"), ("or_in_where", "OR")]),
        ("SELECT TOP 3\n*\nFROM t CROSS JOIN u{n}", [("select_star", "SELECT TOP 3\n*"), ("cross_join", "CROSS JOIN")]),
        ("SELECT a FROM t WHERE UPPER ( a ) = 'A' AND b LIKE\n N'%{n}'", [("function_on_column", "UPPER ( a )"), ("leading_wildcard_like", "LIKE\n N'%{n}'")]),
    ],
    "postgres": [
        ("SELECT a FROM t\rORDER BY random ( ) \n OFFSET 2000{n}", [("order_by_random_with_limit", "random ( )"), ("offset_without_limit", "OFFSET"), ("large_offset_pagination", "OFFSET 2000{n}")]),
        ("SELECT a, (\n SELECT max(b) FROM d\n WHERE d.k = t.k\n) FROM t WHERE c = {n}", [("subquery_in_select_list", "(\n SELECT max(b) FROM d\n WHERE d.k = t.k\n)")]),
        ("WITH x AS (\nUPDATE t SET a = {n} RETURNING b)\nSELECT DISTINCT * FROM x JOIN y ON 1 = 1", [("missing_where_on_update_delete", "UPDATE t"), ("distinct_on_large_result", "SELECT DISTINCT"), ("select_star_with_join", "SELECT DISTINCT *")]),
        ("SELECT a FROM t WHERE user_id\n= '{n}'", [("implicit_type_cast", "user_id\n= '{n}'")]),
    ],
}
SHAPE_OF = "SELECT event_id AS id, (event_id % {})::INT AS shape FROM events"


def _texts(shapes):
    def make(spark, sf_dir):
        e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"))
        text = F.element_at(F.array(*(F.lit(t) for t, _ in shapes)), (F.pmod("id", F.lit(len(shapes))) + 1).cast("int"))
        return e.select("id", F.replace(text, F.lit("{n}"), F.col("id").cast("string")).alias("text"))

    return make


def _expected(shapes, columns: str, rows) -> str:
    cells = [f"({i}, " + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in row) + ")" for i, (t, found) in enumerate(shapes) for row in rows(t, found)]
    return f"WITH s AS ({SHAPE_OF.format(len(shapes))}), f(shape, {columns}) AS (VALUES {', '.join(cells)}) SELECT id, {columns} FROM s JOIN f USING (shape)"


def _expected_places(engine: str) -> str:
    """The same with the place where each part begins, and its text; {n} is filled in by SQL."""
    cells = []
    for i, (text, found) in enumerate(PLACED[engine]):
        for rule, line, column, part in _placed_parts(text, found):
            cells.append(f"({i}, '{rule}', {line}, {column}, {_quoted(part)})")
    return f"WITH s AS ({SHAPE_OF.format(len(PLACED[engine]))}), f(shape, rule, line, col, part) AS (VALUES {', '.join(cells)}) SELECT id, rule, line, col AS \"column\", replace(part, '{{n}}', id::VARCHAR) AS snippet FROM s JOIN f USING (shape)"


def _quoted(text: str) -> str:
    """A text as SQL; line ends as chr()."""
    out = "'" + text.replace("'", "''") + "'"
    for end in ("\n", "\r"):
        out = out.replace(end, f"' || chr({ord(end)}) || '")
    return out


def _placed_parts(text, found):
    out, last = [], {}
    for rule, part in found:
        at = text.index(part, last.get(rule, -1) + 1)
        last[rule] = at
        before = text[:at].replace("\r\n", "\n").replace("\r", "\n")
        out.append((rule, before.count("\n") + 1, len(before) - before.rfind("\n"), part))
    return out


def _counted(text, found):
    return sorted({(r, sum(r == q for q, _ in found)) for r, _ in found})


def _placed(text, found):
    """Line and column where each covered part begins; the parts of one rule follow each other."""
    out, last = [], {}
    for rule, part in found:
        cut = part.partition("{n}")[0]
        at = text.index(cut, last.get(rule, -1) + 1)
        last[rule] = at
        before = text[:at].replace("\r\n", "\n")
        out.append((rule, before.count("\n") + 1, len(before) - before.rfind("\n")))
    return out


SHARES = (
    ", f AS (SELECT context_normalized AS operation, count(*) AS calls, sum(own_us)::BIGINT / 1000.0::DOUBLE AS total_duration_ms, avg(own_us) / 1000.0::DOUBLE AS avg_duration_ms,"
    " coalesce(sum(CASE WHEN event_type = 'DBMSSQL' THEN duration_us ELSE 0 END)::DOUBLE / nullif(sum(duration_us), 0)::DOUBLE, 0) AS sql_share, (count(*) FILTER (WHERE event_type IN ('TLOCK', 'TDEADLOCK')))::DOUBLE / count(*) AS lock_share"
    " FROM ev WHERE context_normalized IS NOT NULL GROUP BY 1) SELECT operation, CASE WHEN sql_share >= 0.5 THEN 'slow_op_heavy_sql' WHEN lock_share >= 0.3 THEN 'slow_op_locks' WHEN calls >= 1000 AND avg_duration_ms <= 50 THEN 'slow_op_call_cascade'"
    " WHEN total_duration_ms >= 60000 THEN 'operation_heavy' END AS explanation FROM f"
)

DEADLOCK_FIGURES = (
    ", d AS (SELECT id, event_type, len(string_split(json_extract_string(extra, '$.Regions'), ',')) AS regions, list_concat([session_id::VARCHAR], string_split(json_extract_string(extra, '$.WaitConnections'), ','),"
    " regexp_extract_all(json_extract_string(extra, '$.DeadlockConnectionIntersections'), '(\\S+)->', 1)) AS who FROM ev WHERE event_type = 'TDEADLOCK')"
    " SELECT id, CASE WHEN regions = 1 AND len(list_distinct(who)) >= 2 THEN 'deadlock_lock_escalation' WHEN regions >= 2 AND len(list_distinct(who)) >= 2 THEN 'deadlock_different_order' ELSE 'deadlock_single_resource' END AS explanation FROM d"
)
DESCRIPTION = "CASE WHEN id % 3 = 0 THEN 'Deadlock found ' || id WHEN id % 3 = 1 THEN 'превышено время ожидания' ELSE 'other' END"


def _deadlocks(spark, sf_dir):
    graphs = an.deadlock_graphs(log_events(spark, sf_dir))
    return ru.explained(graphs.select("id", F.lit("TDEADLOCK").alias("event_type"), F.size("regions").alias("regions_count"), F.size("participants").alias("participants_count")), ("deadlock",)).select("id", "explanation")


def _exceptions(spark, sf_dir):
    rows = log_events(spark, sf_dir).where("event_type IN ('EXCP', 'TLOCK')").select("id", "event_type", F.expr(DESCRIPTION).alias("descr"))
    return ru.explained(rows, ("exception", "lock")).select("id", "explanation")


def _report(spark, sf_dir):
    """The findings of the rules, and the same once more as of another source."""
    found = ru.placed_findings(_texts(QUERY_SHAPES)(spark, sf_dir))
    both = found.withColumn("source", F.lit("native")).unionByName(found.withColumns({"source": F.lit("server"), "severity": F.lit("info")}))
    return ru.report_of(both)


BLANK_TEXT = "concat('SELECT ''a''''b', id, ''' /* x */ - 1 / 2 -- end ', id)"
RAW = """CASE id % 4
  WHEN 0 THEN concat('{"code":"UnionAll","message":"m', id, '","severity":1,"range":{"start":{"line":0,"character":0},"end":{"line":0,"character":5}}}')
  WHEN 1 THEN '{"code":"Other","severity":1,"range":{"start":{"line":0,"character":6},"end":{"line":2,"character":3}}}'
  WHEN 2 THEN '{"code":"Other","severity":"info","range":{"start":{"line":9,"character":0},"end":{"line":9,"character":1}}}'
  ELSE '{"code":"Other","range":{"start":{"line":1,"character":0},"end":{"line":1,"character":6}}}' END"""

IN_LIST = "concat('SELECT a FROM t WHERE b NOT IN (', array_join(sequence(1L, 90 + id % 20), ', '), ') AND c IN ((1), (2))')"
BROKEN = """CASE id % 5 WHEN 0 THEN concat('SELECT a FROM t WHERE b = ', chr(39), id) WHEN 1 THEN concat('SELECT (a + ', id, ' FROM t')
  WHEN 2 THEN concat('SELECT a /* ', id) WHEN 3 THEN concat('no statement ', id) ELSE concat('SELECT ', chr(39), '(', chr(39), ' FROM t -- ', id) END"""
#: Statements, and whether each may be run again for its plan.
EXPLAINABLE = [
    ("SELECT a FROM t WHERE b = 'drop table x'", True), ("EXPLAIN SELECT 1", True), ("TABLE t", True), ("values (1), (2);", True), ("SELECT \"update\" FROM \"set\"", True), ("SELECT $$ DELETE $$", True), ("/* insert */ SELECT 1 -- drop", True),
    ("SELECT reset_at, updated, set_id FROM t", True), ("SELECT 'a -- b' ; DROP TABLE t", False), ("SELECT 1 UNLISTEN x", False), ("SELECT E'a\\'' ; DROP TABLE t --'", False), ("SELECT \"a'\" ; DROP TABLE t --'", False),
    ("/* /* */ ' */ ; DROP TABLE t --'", False), ("SELECT a INTO n FROM t", False), ("WITH x AS (DELETE FROM t RETURNING *) SELECT * FROM x", False), ("REFRESH MATERIALIZED VIEW v", False), ("SELECT 1; SELECT 2", False), ("", False), ("SELECT 'open", False),
    ("SELECT comment, lock FROM t", True), ("SELECT 1 UNION SELECT 2 ORDER BY 1", True), ("copy t to 'x'", False), ("WITH x AS (SELECT 1) SELECT * FROM x", True),
]

QUERIES = {
    "n_query_rules": lambda s, d: ru.query_findings(_texts(QUERY_SHAPES)(s, d)).select("id", "rule", "n"),
    "n_query_ranges": lambda s, d: ru.placed_findings(_texts(QUERY_SHAPES)(s, d)).select("id", "rule", "line", "column"),
    "k8_report": lambda s, d: _report(s, d).groupBy("id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("place").cast("long").alias("last")),
    "a22_severities": lambda s, d: ru.severity_counts(ru.placed_findings(_texts(QUERY_SHAPES)(s, d))),
    "l_mssql_rules": lambda s, d: ru.sql_findings(_texts(SQL_SHAPES["mssql"])(s, d), "mssql").select("id", "rule", "severity"),
    "l_postgres_rules": lambda s, d: ru.sql_findings(_texts(SQL_SHAPES["postgres"])(s, d), "postgres").select("id", "rule", "severity"),
    "l_mssql_places": lambda s, d: ru.placed_sql_findings(_texts(PLACED["mssql"])(s, d), "mssql").select("id", "rule", "line", "column", "snippet"),
    "l_postgres_places": lambda s, d: ru.placed_sql_findings(_texts(PLACED["postgres"])(s, d), "postgres").select("id", "rule", "line", "column", "snippet"),
    "l_in_list_sizes": lambda s, d: ru.sql_findings(log_events(s, d).select("id", F.expr(IN_LIST).alias("text")), "mssql"),
    "l_parse_failed": lambda s, d: log_events(s, d).select("id", ru.parse_failed(F.expr(BROKEN), "postgres").alias("failed")),
    "v2_odd_statements": lambda s, d: log_events(s, d).select("id", ru.safe_to_explain(F.element_at(F.array(*(F.lit(t) for t, _ in EXPLAINABLE)), (F.pmod("id", F.lit(len(EXPLAINABLE))) + 1).cast("int"))).alias("safe")),
    "k9_severity_counts": lambda s, d: ru.sql_findings(_texts(SQL_SHAPES["postgres"])(s, d), "postgres").groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.min(ru.severity_rank(F.col("severity"))).alias("rank")),
    "e1_explained": lambda s, d: ru.explained(vi.operations(log_events(s, d)).join(us.shares(log_events(s, d)), "operation")).select("operation", "explanation"),
    "e1_deadlocks": _deadlocks,
    "e1_exceptions": _exceptions,
    "v2_safe_to_explain": lambda s, d: log_events(s, d).where("sql_text is not null").select("id", ru.safe_to_explain(F.expr(
        "CASE id % 5 WHEN 0 THEN concat('DELETE FROM t; ', sql_text) WHEN 1 THEN concat('WITH x AS (', sql_text, ') SELECT * FROM x') WHEN 2 THEN concat(sql_text, '; DROP TABLE t') WHEN 3 THEN concat('/* update */ ', sql_text, ' -- delete') ELSE concat('SET a = 1; ', sql_text) END")).alias("safe")),
    "x35_blanked": lambda s, d: log_events(s, d).select("id", ru.blanked(F.expr(BLANK_TEXT)).alias("text")),
    "t14_diagnostics": lambda s, d: ru.diagnostics(log_events(s, d).select("id", F.expr(RAW).alias("raw"), F.expr("concat('first ', id, '\\nsecond line\\nthird')").alias("text"))),
    "x33_rendered": lambda s, d: vi.operations(log_events(s, d)).select("operation", ru.rendered("{{operation}}: {{ calls }} calls, {{missing}}", {"operation": F.col("operation"), "calls": F.col("calls")}).alias("text")),
    "x34_words": lambda s, d: log_events(s, d).select("id", ru.one_of(F.concat(F.lit(" "), F.upper("event_type")), {"excp": "error", "tlock": "lock"}, "other").alias("word")),
}
SEVERITY = {r: s for r, s, _ in ru.QUERY_RULES}
ORACLES = {
    "n_query_rules": _expected(QUERY_SHAPES, "rule, n", _counted),
    "n_query_ranges": _expected(QUERY_SHAPES, 'rule, line, "column"', _placed),
    "k8_report": f"SELECT id, 'native' AS source, count(*) AS n, count(*) AS last FROM ({_expected(QUERY_SHAPES, 'rule, line, c', _placed)}) GROUP BY id",
    "a22_severities": "SELECT id, " + ", ".join(f"count(*) FILTER (WHERE rule IN ({', '.join(repr(r) for r, s in SEVERITY.items() if s == w)})) AS {w}" for w in ("critical", "warning", "info")) + f" FROM ({_expected(QUERY_SHAPES, 'rule, line, c', _placed)}) GROUP BY id",
    "l_mssql_rules": _expected(SQL_SHAPES["mssql"], "rule, severity", lambda t, found: found),
    "l_postgres_rules": _expected(SQL_SHAPES["postgres"], "rule, severity", lambda t, found: found),
    "l_mssql_places": _expected_places("mssql"),
    "l_postgres_places": _expected_places("postgres"),
    "l_in_list_sizes": "SELECT event_id AS id, 'large_in_list' AS rule, 'Major' AS severity FROM events WHERE event_id % 20 >= 10",
    "l_parse_failed": "SELECT event_id AS id, event_id % 5 < 4 AS failed FROM events",
    "v2_odd_statements": "SELECT event_id AS id, [" + ", ".join(str(ok).lower() for _, ok in EXPLAINABLE) + f"][event_id % {len(EXPLAINABLE)} + 1] AS safe FROM events",
    "k9_severity_counts": f"SELECT severity, count(*) AS n, CASE severity WHEN 'Critical' THEN 1 WHEN 'Warning' THEN 4 ELSE 6 END::BIGINT AS rank FROM ({_expected(SQL_SHAPES['postgres'], 'rule, severity', lambda t, found: found)}) GROUP BY severity",
    "e1_explained": EV + SHARES,
    "e1_deadlocks": EV + DEADLOCK_FIGURES,
    "e1_exceptions": EV + "SELECT id, CASE WHEN event_type = 'TLOCK' THEN 'lock_timeout' WHEN id % 3 = 0 THEN 'exception_deadlock_victim' WHEN id % 3 = 1 THEN 'exception_timeout' END AS explanation FROM ev WHERE event_type IN ('EXCP', 'TLOCK')",
    "v2_safe_to_explain": EV + "SELECT id, id % 5 IN (1, 3) AS safe FROM ev WHERE sql_text IS NOT NULL",
    "x35_blanked": EV + "SELECT id, 'SELECT ' || chr(39) || repeat(' ', 4 + length(id::VARCHAR)) || chr(39) || repeat(' ', 9) || '- 1 / 2 ' || repeat(' ', 7 + length(id::VARCHAR)) AS text FROM ev",
    "t14_diagnostics": EV + "SELECT id, CASE WHEN id % 4 = 0 THEN 'UnionAll' ELSE 'Other' END AS code, CASE WHEN id % 4 = 0 THEN 'm' || id ELSE '' END AS message, CASE id % 4 WHEN 1 THEN 'Critical' WHEN 2 THEN 'Info' ELSE 'Major' END AS severity, CASE id % 4 WHEN 2 THEN 9 WHEN 3 THEN 1 ELSE 0 END AS start_line,"
    " CASE id % 4 WHEN 1 THEN 6 ELSE 0 END AS start_character, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 9 ELSE 1 END AS end_line, CASE id % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 6 END AS end_character,"
    " CASE id % 4 WHEN 0 THEN 'first' WHEN 1 THEN id || chr(10) || 'second line' || chr(10) || 'thi' WHEN 3 THEN 'second' END AS snippet FROM ev",
    "x33_rendered": EV + "SELECT context_normalized AS operation, context_normalized || ': ' || count(*) || ' calls, —' AS text FROM ev WHERE context_normalized <> '' GROUP BY 1",
    "x34_words": EV + "SELECT id, CASE event_type WHEN 'EXCP' THEN 'error' WHEN 'TLOCK' THEN 'lock' ELSE 'other' END AS word FROM ev",
}

"""Queries of the text functions, over texts made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import EV, log_events
from ..functions import text as tx

PLAN = "concat('Seq Scan on t', k % 12, '  (cost=0.00..9.50 rows=', k, ' width=8) (actual time=0.1..2.', k, ' rows=', k, ' loops=1)\\n  Buffers: shared hit=', k, '\\nPlanning Time: 0.', k, ' ms')"


def _k(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


K = "WITH e AS (SELECT event_id AS id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) "
LITERALS = """concat("SELECT  N'a''b", k, "' , 0xAF", k, ", ", k, ".5 FROM t", k, " WHERE x = @P", k, "  AND y = 'z'")"""
CONTEXT = "CASE k % 5 WHEN 0 THEN concat('  Doc.Op', k, '.Form : ', user_id, ' : run') WHEN 1 THEN concat('\\n Doc.Op', k, '\\nsecond : x') WHEN 2 THEN concat(' : led ', k) WHEN 3 THEN concat('plain ', k, '\\t') ELSE '  ' END"
CALL = """CASE k % 4 WHEN 0 THEN concat("exec sp_executesql N'SELECT a FROM t WHERE b = ''x", k, "'' ', N'@P1 int'") WHEN 1 THEN concat("{call sp_executesql(N'SELECT ", k, "', N'@P1 int', 5)}") WHEN 2 THEN concat("SELECT 'sp_executesql N', ", k) ELSE concat("EXECUTE sp_executesql N'SELECT ", k, "'") END"""
PLANS = """element_at(array('<ShowPlanXML>', '[{"Plan": {}}]', 'Seq Scan on t  (cost=0.00..1.00 rows=1)', 'nothing', '<html>', '  |--Clustered Index Seek(OBJECT:(t))', 'Planning Time: 1 ms', ' {"Plan": {"a": 1}} ', 'Nested Loop over it'), cast(k % 9 + 1 as int))"""
TABLES = "element_at(array('_Reference12', 't', '_Fld7', '[_Task3]', 'x_Enum1', 'dbo._CRRd5', 'CAST(a AS mvarchar(5))', 'a::text'), cast(k % 8 + 1 as int))"

QUERIES = {
    "x1_normalize_sql": lambda s, d: _k(s, d).select("id", tx.normalize_sql(F.expr(LITERALS)).alias("normal")),
    "x2_normalize_context": lambda s, d: _k(s, d).select("id", tx.normalize_context(F.expr(CONTEXT)).alias("context")),
    "x5_file_hour": lambda s, d: _k(s, d).select("id", tx.file_hour(F.concat(F.lpad((F.col("k") % 30).cast("string"), 2, "0"), F.lit("0"), (F.col("k") % 10).cast("string"), F.lit("1512.log"))).alias("hour")),
    "x24_pg_plan": lambda s, d: _k(s, d).select("id", tx.canonical_pg_text(F.expr(PLAN)).alias("plan")),
    "x26_query": lambda s, d: _k(s, d).select("id", tx.canonical_query(F.expr("concat('SELECT a, // note ', k, '\\n b /* more ', k, ' */  FROM t', k)")).alias("query")),
    "x26_description": lambda s, d: _k(s, d).select("id", tx.canonical_description(F.expr("concat('  Slow -- «Query» (', k, '), WHY?! ')")).alias("description")),
    "x27_cache_key": lambda s, d: _k(s, d).select("id", tx.cache_key(F.col("k").cast("string"), "plan", "1", "m").alias("key")),
    "x28_short_key": lambda s, d: _k(s, d).select("id", tx.short_key(F.col("k").cast("string"), F.lit("a"), F.lit("b")).alias("key")),
    "x29_plan_engine": lambda s, d: _k(s, d).select("id", tx.plan_engine(F.expr(PLANS)).alias("engine")),
    "x30_unwrap": lambda s, d: _k(s, d).select("id", tx.unwrap_executesql(F.expr(CALL)).alias("statement")),
    "x31_platform_sql": lambda s, d: _k(s, d).select("id", tx.is_platform_sql(F.concat(F.lit("SELECT 1 FROM "), F.expr(TABLES))).alias("platform")),
    "r2_context_signature": lambda s, d: log_events(s, d).where("context is not null").select("id", tx.context_signature(F.concat(F.lit("at 2024-01-02 03:04:05.6 Сеанс=12 Id=7 № A-1  "), "context")).alias("signature")),
}
ORACLES = {
    "x1_normalize_sql": K + "SELECT id, 'SELECT ? , ?, ? FROM t' || k || ' WHERE x = ? AND y = ?' AS normal FROM e",
    "x2_normalize_context": K + "SELECT id, CASE k % 5 WHEN 0 THEN 'Doc.Op' || k || '.Form' WHEN 1 THEN 'Doc.Op' || k || chr(10) || 'second' WHEN 2 THEN ': led ' || k WHEN 3 THEN 'plain ' || k END AS context FROM e",
    "x5_file_hour": K + "SELECT id, CASE WHEN k % 10 > 0 THEN make_timestamp(2000 + k % 30, k % 10, 15, 12, 0, 0.0) END AS hour FROM e",
    "x24_pg_plan": K + "SELECT id, 'Seq Scan on t' || (k % 12) || ' (cost=0.00..9.50 rows=' || k || ' width=8)' AS plan FROM e",
    "x26_query": K + "SELECT id, 'SELECT a, b FROM t' || k AS query FROM e",
    "x26_description": K + "SELECT id, 'slow query ' || k || ' why' AS description FROM e",
    "x27_cache_key": K + "SELECT id, sha256(k || '|type_plan|prompt_1|model_m') AS key FROM e",
    "x28_short_key": K + "SELECT id, substr(sha256(k || '|a|b'), 1, 32) AS key FROM e",
    "x29_plan_engine": K + "SELECT id, ['mssql', 'postgres', 'postgres', 'unknown', 'unknown', 'mssql', 'postgres', 'postgres', 'postgres'][k % 9 + 1] AS engine FROM e",
    "x30_unwrap": K + "SELECT id, CASE k % 4 WHEN 0 THEN 'SELECT a FROM t WHERE b = ' || chr(39) || 'x' || k || chr(39) || ' ' WHEN 1 THEN 'SELECT ' || k WHEN 2 THEN 'SELECT ' || chr(39) || 'sp_executesql N' || chr(39) || ', ' || k ELSE 'SELECT ' || k END AS statement FROM e",
    "x31_platform_sql": K + "SELECT id, k % 8 NOT IN (1, 4, 7) AS platform FROM e",
    "r2_context_signature": EV + "SELECT id, 'at [TS] Сеанс=[S] Id=[N] №[N] ' || context AS signature FROM ev WHERE context IS NOT NULL",
}

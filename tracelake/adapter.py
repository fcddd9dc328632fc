"""The ``events`` table of log events made from the plain test table of that name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize_context, normalize_sql, sql_hash

ROLES = ("rphost", "rmngr", "ragent", "1cv8c")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind, user = F.col("k"), F.col("event_type"), F.col("user_id")
    # The JSON is parsed once a row: what filters ask of k can't be moved below this.
    base = spark.read.parquet(f"{sf_dir}/events.parquet").select("*", F.explode(F.array(F.get_json_object("props", "$.k").cast("long"))).alias("k"))
    error = F.when(k % 4 == 0, "EXCPCNTX").otherwise("EXCP")
    lock = F.when(k % 10 == 0, "TDEADLOCK").otherwise("TLOCK")
    sql = F.when(k % 2 == 0, "DBMSSQL").otherwise("DBPOSTGRS")
    t = F.when(kind == "click", "CALL").when(kind == "view", "SCALL").when(kind == "purchase", sql).when(kind == "error", error).otherwise(lock)
    # In archive B one statement is slower, one faster and one new.
    second = F.dayofmonth("ts") > 15
    table = k % 12 + F.when(second & (k % 12 == 6), 12).otherwise(0)
    drift = F.when(second & (k % 12 == 2), 4).when(second & (k % 12 == 4), 1).otherwise(2)
    text = F.when(kind == "purchase", F.concat(F.lit("SELECT * FROM t"), table, F.lit(" WHERE id = "), "event_id"))
    context = F.when(k % 5 != 0, F.concat(F.lit("Doc.Op"), k % 20, F.lit(".Module : "), k, F.lit(" : call")))
    locks = F.concat(
        F.lit('{"Regions":"Reg.R'), k % 3, F.lit(" Exclusive, Doc.D"), k % 2, F.lit(' Shared","WaitConnections":"'), user, F.lit(","), user + 1,
        F.lit('","DeadlockConnectionIntersections":"'), user, F.lit("->Reg.R"), k % 3, F.lit(" | "), user + 1, F.lit("->Doc.D"), k % 2, F.lit('"}'),
    )
    extra = F.when(kind == "signup", locks).when(kind == "error", F.concat(F.lit('{"Exception":"Err'), k % 6, F.lit('","Descr":"at '), k, F.lit('"}')))
    extra = extra.when(kind == "click", F.concat(F.lit('{"Memory":"'), k * 1000, F.lit('","MemoryPeak":"'), k * 2000, F.lit('"}')))
    plan = F.when(text.isNotNull() & (k % 3 == 0), F.concat(F.lit("Seq Scan on t"), table, F.lit("  (cost=0.00.."), k, F.lit(".50 rows="), k, F.lit(" width=8)")))
    rows = base.select(
        F.col("event_id").alias("id"), F.when(second, "B").otherwise("A").alias("archive_id"), "ts",
        (F.round(F.col("value") * 1000).cast("long") * (1 + k * k) * drift).alias("duration_us"), t.alias("event_type"), user.cast("int").alias("session_id"),
        F.concat(F.lit("u"), user).alias("user_name"), context.alias("context"), normalize_context(context).alias("context_normalized"),
        F.lit("app").alias("process"), F.element_at(F.array(*map(F.lit, ROLES)), (user % 4 + 1).cast("int")).alias("process_role"), (1000 + user % 7).cast("int").alias("process_pid"),
        text.alias("sql_text"), normalize_sql(text).alias("sql_text_normalized"), plan.alias("plan_text"),
        F.when(text.isNotNull(), k * 10).alias("rows_read"), F.when(text.isNotNull(), k % 7).alias("rows_modified"), extra.alias("extra"),
        F.lit("sample.log").alias("source_file"), F.lit(1).alias("source_line_start"),
        F.when(t == "DBMSSQL", "mssql").when(t == "DBPOSTGRS", "postgres").alias("engine"),
    )
    return rows.withColumn("sql_text_hash", sql_hash(F.col("sql_text_normalized")))


#: The same in SQL: ``ev``.
EV = """WITH b0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, day(ts) > 15 AS second FROM events),
base AS (SELECT *, k % 12 + CASE WHEN second AND k % 12 = 6 THEN 12 ELSE 0 END AS tab, CASE WHEN second AND k % 12 = 2 THEN 4 WHEN second AND k % 12 = 4 THEN 1 ELSE 2 END AS drift FROM b0),
e0 AS (SELECT event_id AS id, CASE WHEN second THEN 'B' ELSE 'A' END AS archive_id, ts,
 CAST(round(value * 1000) AS BIGINT) * (1 + k * k) * drift AS duration_us,
 CASE event_type WHEN 'click' THEN 'CALL' WHEN 'view' THEN 'SCALL' WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'DBMSSQL' ELSE 'DBPOSTGRS' END
  WHEN 'error' THEN CASE WHEN k % 4 = 0 THEN 'EXCPCNTX' ELSE 'EXCP' END ELSE CASE WHEN k % 10 = 0 THEN 'TDEADLOCK' ELSE 'TLOCK' END END AS event_type,
 CAST(user_id AS INT) AS session_id, 'u' || user_id AS user_name,
 CASE WHEN k % 5 <> 0 THEN 'Doc.Op' || (k % 20) || '.Module : ' || k || ' : call' END AS context,
 CASE WHEN k % 5 <> 0 THEN trim(split_part('Doc.Op' || (k % 20) || '.Module : ' || k || ' : call', ':', 1)) END AS context_normalized,
 CASE user_id % 4 WHEN 0 THEN 'rphost' WHEN 1 THEN 'rmngr' WHEN 2 THEN 'ragent' ELSE '1cv8c' END AS process_role,
 CAST(1000 + user_id % 7 AS INT) AS process_pid,
 CASE WHEN event_type = 'purchase' THEN 'SELECT * FROM t' || tab || ' WHERE id = ' || event_id END AS sql_text,
 CASE WHEN event_type = 'purchase' THEN 'SELECT * FROM t' || tab || ' WHERE id = ?' END AS sql_text_normalized,
 CASE WHEN event_type = 'purchase' AND k % 3 = 0 THEN 'Seq Scan on t' || tab || '  (cost=0.00..' || k || '.50 rows=' || k || ' width=8)' END AS plan_text,
 CASE WHEN event_type = 'purchase' THEN k * 10 END AS rows_read,
 CASE WHEN event_type = 'signup' THEN '{"Regions":"Reg.R' || (k % 3) || ' Exclusive, Doc.D' || (k % 2) || ' Shared","WaitConnections":"' || user_id || ',' || (user_id + 1)
   || '","DeadlockConnectionIntersections":"' || user_id || '->Reg.R' || (k % 3) || ' | ' || (user_id + 1) || '->Doc.D' || (k % 2) || '"}'
  WHEN event_type = 'error' THEN '{"Exception":"Err' || (k % 6) || '","Descr":"at ' || k || '"}'
  WHEN event_type = 'click' THEN '{"Memory":"' || (k * 1000) || '","MemoryPeak":"' || (k * 2000) || '"}' END AS extra,
 CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'mssql' ELSE 'postgres' END END AS engine FROM base),
ev AS (SELECT *, md5(sql_text_normalized) AS sql_text_hash, duration_us / 1000.0::DOUBLE AS duration_ms,
 CASE WHEN event_type NOT IN ('EXCPCNTX', 'Context') THEN coalesce(duration_us, 0) END AS own_us FROM e0)
"""

"""Ready-made reports, by name, in Spark SQL over ``{events}``. Equal ranks go by the last columns of the order."""

from __future__ import annotations

from pyspark.sql import DataFrame

JSON = "get_json_object(extra, '$.{}')".format
TEMPLATES = {
    "top_slow_sql": """
        SELECT max_by(coalesce(sql_text, sql_text_normalized), CASE WHEN coalesce(sql_text, sql_text_normalized) IS NOT NULL THEN struct(coalesce(duration_us, 0), -id) END) AS query,
          count(*) AS calls, sum(duration_us) / 1000D AS total_ms, avg(duration_us) / 1000D AS avg_ms, max(duration_us) / 1000D AS max_ms
        FROM {events} WHERE event_type = 'DBMSSQL' AND sql_text_hash IS NOT NULL GROUP BY sql_text_hash ORDER BY total_ms DESC NULLS LAST, sql_text_hash LIMIT 100""",
    "long_server_calls": """
        SELECT ts, process_role, context, duration_ms FROM (
          SELECT id, ts, process_role, context, duration_us / 1000D AS duration_ms FROM {events} WHERE event_type IN ('CALL', 'SCALL') AND duration_us > 10000000)
        ORDER BY duration_ms DESC, id LIMIT 100""",
    "top_contexts_slow": """
        SELECT context, count(*) AS calls, sum(duration_us) / 1000D AS total_ms, avg(duration_us) / 1000D AS avg_ms
        FROM {events} WHERE context IS NOT NULL GROUP BY context ORDER BY total_ms DESC NULLS LAST, context LIMIT 50""",
    "deadlocks_by_hour": """
        SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS hour, count(*) AS deadlocks FROM {events} WHERE event_type = 'TDEADLOCK' GROUP BY 1 ORDER BY 1""",
    "locks_top_resources": f"""
        SELECT {JSON("Regions")} AS resource, count(*) AS lock_events FROM {{events}} WHERE event_type = 'TLOCK' GROUP BY 1 ORDER BY lock_events DESC, resource LIMIT 50""",
    "lock_wait_sessions": f"""
        SELECT ts, session_id, user_name, wait_for FROM (SELECT id, ts, session_id, user_name, {JSON("WaitConnections")} AS wait_for FROM {{events}} WHERE event_type = 'TLOCK')
        WHERE wait_for IS NOT NULL ORDER BY ts DESC, id DESC LIMIT 100""",
    "exceptions_feed": f"""
        SELECT ts, process_role, context, exception, description FROM (
          SELECT id, ts, process_role, context, {JSON("Exception")} AS exception, {JSON("Descr")} AS description FROM {{events}} WHERE event_type = 'EXCP')
        ORDER BY ts DESC, id DESC LIMIT 200""",
    "errors_by_type": f"""
        SELECT {JSON("Exception")} AS exception_type, count(*) AS cnt FROM {{events}} WHERE event_type = 'EXCP' GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 50""",
    "memory_heavy_events": f"""
        SELECT ts, event_type, process_role, context, memory, memory_peak FROM (
          SELECT id, ts, event_type, process_role, context, {JSON("Memory")} AS memory, {JSON("MemoryPeak")} AS memory_peak FROM {{events}})
        WHERE memory_peak IS NOT NULL ORDER BY try_cast(memory_peak AS BIGINT) DESC NULLS LAST, id LIMIT 100""",
    "events_by_role_and_type": """
        SELECT process_role, event_type, count(*) AS cnt FROM {events} GROUP BY 1, 2 ORDER BY process_role, cnt DESC, event_type""",
    "activity_by_hour": """
        SELECT hour(ts) AS hour_of_day, count(*) AS events, sum(duration_us) / 1000D AS total_ms, count_if(event_type = 'EXCP') AS exceptions FROM {events} GROUP BY 1 ORDER BY 1""",
    "sessions_overview": """
        SELECT session_id, user_name, count(*) AS events, sum(duration_us) / 1000D AS total_ms, min(ts) AS first_event, max(ts) AS last_event, count(DISTINCT context) AS unique_contexts
        FROM {events} WHERE session_id IS NOT NULL GROUP BY 1, 2 ORDER BY total_ms DESC NULLS LAST, session_id, user_name LIMIT 100""",
    "events_count_overview": """
        SELECT event_type, count(*) AS cnt, round(count(*) * 100D / sum(count(*)) OVER (), 2) AS percent FROM {events} GROUP BY event_type ORDER BY cnt DESC, event_type""",
}


def template(events: DataFrame, name: str) -> DataFrame:
    return events.sparkSession.sql(TEMPLATES[name], events=events)

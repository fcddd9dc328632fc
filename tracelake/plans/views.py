"""Queries of the log views, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import EV, log_events
from ..functions import deadlocks, plan_lines
from ..operators import anatomy as an
from ..operators import compare as co
from ..operators import filters as fi
from ..operators import templates as te
from ..operators import usage as us
from ..operators import views as vi

OPERATION, SESSION = "Doc.Op8.Module", 7
SINCE, UNTIL = "2024-01-02 00:00:00", "2024-01-20 12:00:00"
ROLES = "string_agg(DISTINCT process_role, ', ' ORDER BY process_role)"
SLOWEST = "arg_max(sql_text, row(coalesce(duration_us, 0), -id))"
D = "::DOUBLE"

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, make, sql: str | None = None, log: bool = True) -> None:
    QUERIES[name] = (lambda spark, sf: make(log_events(spark, sf))) if log else make
    if sql is not None:
        ORACLES[name] = EV + sql if log else sql


def slow_sql(where: str, order: str, limit: int = 100) -> str:
    return (
        f"SELECT sql_text_hash, {SLOWEST} AS query, count(*) AS calls, sum(duration_us)::BIGINT / 1000.0{D} AS total_duration_ms, avg(duration_us) / 1000.0{D} AS avg_duration_ms,"
        f" max(duration_us) / 1000.0{D} AS max_duration_ms, sum(coalesce(rows_read, 0))::BIGINT AS total_rows_read, min(ts) AS first_seen, max(ts) AS last_seen, {ROLES} AS process_roles"
        f" FROM ev WHERE event_type = 'DBMSSQL' AND sql_text_normalized IS NOT NULL AND {where} GROUP BY sql_text_hash ORDER BY {order} DESC NULLS LAST, sql_text_hash LIMIT {limit}"
    )


for key, column in vi.SLOW_ORDERS.items():
    add(f"a1_slow_queries_{key.split('_')[0]}", lambda e, key=key: vi.slow_queries(e, key), slow_sql("true", column))
SPAN = f"ts >= TIMESTAMP '{SINCE}' AND ts <= TIMESTAMP '{UNTIL}'"
add("a1_slow_queries_filtered", lambda e: vi.slow_queries(fi.filtered(e, SINCE, UNTIL, "rphost")), slow_sql(f"{SPAN} AND process_role = 'rphost'", "total_duration_ms"))
for unit in ("minute", "hour", "day"):
    add(
        f"a2_locks_{unit}", lambda e, unit=unit: vi.locks_timeline(e, unit),
        f"SELECT date_trunc('{unit}', ts)::TIMESTAMP AS bucket, count(*) FILTER (WHERE event_type = 'TLOCK') AS locks, count(*) FILTER (WHERE event_type = 'TDEADLOCK') AS deadlocks"
        " FROM ev WHERE event_type IN ('TLOCK', 'TDEADLOCK') GROUP BY 1 ORDER BY 1 LIMIT 5000",
    )
add(
    "a4_process_roles", vi.process_roles,
    f"SELECT process_role, count(*) AS events_count, sum(own_us)::BIGINT / 1000.0{D} AS total_duration_ms, count(DISTINCT process_pid) AS unique_processes, avg(own_us) / 1000.0{D} AS avg_duration_ms"
    " FROM ev WHERE process_role IS NOT NULL GROUP BY 1",
)
BUCKETS = ", ".join(f"({i}, '{label}', {lo}, {hi if hi is not None else 'NULL'})" for i, (label, lo, hi) in enumerate(vi.BUCKETS))
add(
    "a5_duration_histogram", vi.duration_histogram,
    f", x AS (SELECT own_us AS us FROM ev WHERE duration_us IS NOT NULL AND own_us IS NOT NULL), b(position, label, lo, hi) AS (VALUES {BUCKETS})"
    f" SELECT position::INT AS position, label, count(us) AS count, round(count(us) * 100.0{D} / (SELECT count(*) FROM x), 2) AS percent FROM b LEFT JOIN x ON us >= lo AND (hi IS NULL OR us < hi) GROUP BY 1, 2, b.position",
)
FEED = "SELECT id, ts, event_type, process_role, process_pid, context, duration_ms, extra FROM ev WHERE {} ORDER BY ts DESC, id DESC LIMIT 500"
add("a6_events_feed", vi.events_feed, FEED.format("true"))
add("a6_feed_of_types", lambda e: vi.events_feed(e, ("EXCP", "TDEADLOCK")), FEED.format("event_type IN ('EXCP', 'TDEADLOCK')"))
add("a6_feed_with_context", lambda e: vi.events_feed(e, presence="with"), FEED.format("context IS NOT NULL AND trim(context) <> ''"))
add("a6_feed_without_context", lambda e: vi.events_feed(e, presence="without"), FEED.format("NOT (context IS NOT NULL AND trim(context) <> '')"))
add("a1_total_rows", vi.slow_queries_total, "SELECT count(DISTINCT sql_text_hash) AS total_rows FROM ev WHERE event_type = 'DBMSSQL' AND sql_text_normalized IS NOT NULL")
add("a6_total_rows", lambda e: vi.events_feed_total(e, ("EXCP", "TLOCK"), "without"), "SELECT count(*) AS total_rows FROM ev WHERE event_type IN ('EXCP', 'TLOCK') AND NOT (context IS NOT NULL AND trim(context) <> '')")
add("a7_total_rows", lambda e: vi.operations_total(e, ("CALL", "EXCP")), "SELECT count(DISTINCT context_normalized) AS total_rows FROM ev WHERE event_type IN ('CALL', 'EXCP') AND context_normalized <> ''")
add("p4_engines", lambda e: e.select("id", vi.engine_of().alias("engine")), "SELECT id, coalesce(engine, CASE event_type WHEN 'DBMSSQL' THEN 'mssql' WHEN 'DBPOSTGRS' THEN 'postgres' END) AS engine FROM ev")
add("a6_type_counts", vi.type_counts, "SELECT event_type, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, 1 LIMIT 200")
for key, column in vi.OPERATION_ORDERS.items():
    add(
        f"a7_top_operations_{key}", lambda e, key=key: vi.top_operations(e, key),
        f"SELECT context_normalized AS operation, count(*) AS calls, sum(own_us)::BIGINT / 1000.0{D} AS total_duration_ms, avg(own_us) / 1000.0{D} AS avg_duration_ms, max(own_us) / 1000.0{D} AS max_duration_ms,"
        f" sum(CASE WHEN event_type = 'DBMSSQL' THEN coalesce(duration_us, 0) ELSE 0 END)::BIGINT / 1000.0{D} AS sql_duration_ms, count(*) FILTER (WHERE event_type IN ('TLOCK', 'TDEADLOCK')) AS lock_events,"
        f" count(*) FILTER (WHERE event_type = 'EXCP') AS exception_events, count(DISTINCT session_id) AS unique_sessions, {ROLES} AS process_roles, min(ts) AS first_seen, max(ts) AS last_seen"
        f" FROM ev WHERE context_normalized IS NOT NULL GROUP BY 1 ORDER BY {column} DESC NULLS LAST, 1 LIMIT 100",
    )
for metric, value in (
    ("count", f"count(*){D}"), ("total_duration_ms", f"sum(own_us)::BIGINT / 1000.0{D}"), ("peak_duration_ms", f"max(own_us) / 1000.0{D}"), ("error_count", f"(count(*) FILTER (WHERE event_type IN ('EXCP', 'TDEADLOCK'))){D}"),
):
    add(f"a8_heatmap_{metric.split('_')[0]}", lambda e, metric=metric: vi.activity_heatmap(e, metric), f"SELECT ((extract(dow FROM ts) + 6) % 7)::INT AS y, hour(ts)::INT AS x, {value} AS value FROM ev GROUP BY 1, 2")
COUNTS = "count(*) FILTER (WHERE event_type = 'EXCP') AS exception_count, count(*) FILTER (WHERE event_type IN ('TLOCK', 'TDEADLOCK')) AS lock_count, count(*) FILTER (WHERE event_type = 'DBMSSQL') AS sql_count"
SEEN = f"min(ts) AS first_seen, max(ts) AS last_seen, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0{D} AS wall_clock_ms, count(*) > 0 AS found"
OF_OP, OF_SESSION = f"context_normalized = '{OPERATION}'", f"session_id = {SESSION}"
add(
    "a9_operation_summary", lambda e: an.operation_summary(an.of_operation(e, OPERATION)),
    f"SELECT count(*) AS total_events, coalesce(sum(own_us), 0)::BIGINT / 1000.0{D} AS total_duration_ms, avg(own_us) / 1000.0{D} AS avg_duration_ms, max(own_us) / 1000.0{D} AS max_duration_ms,"
    f" min(nullif(own_us, 0)) / 1000.0{D} AS min_duration_ms, count(DISTINCT session_id) AS unique_sessions, count(DISTINCT process_pid) AS unique_processes, {ROLES} AS process_roles, {COUNTS}, {SEEN} FROM ev WHERE {OF_OP}",
)
add(
    "a12_session_summary", lambda e: an.session_summary(an.of_session(e, SESSION)),
    f"SELECT count(*) AS total_events, string_agg(DISTINCT user_name, ', ' ORDER BY user_name) AS users, {ROLES} AS process_roles, string_agg(DISTINCT process_pid::VARCHAR, ', ' ORDER BY process_pid::VARCHAR) AS process_pids,"
    f" count(DISTINCT context_normalized) AS distinct_operations, coalesce(sum(own_us), 0)::BIGINT / 1000.0{D} AS total_duration_ms, {COUNTS}, {SEEN} FROM ev WHERE {OF_SESSION}",
)
for prefix, of, where in (("a10_operation", lambda e: an.of_operation(e, OPERATION), OF_OP), ("a12_session", lambda e: an.of_session(e, SESSION), OF_SESSION)):
    add(f"{prefix}_breakdown", lambda e, of=of: an.breakdown(of(e)), f"SELECT event_type, count(*) AS events, sum(duration_us)::BIGINT / 1000.0{D} AS total_duration_ms, avg(duration_us) / 1000.0{D} AS avg_duration_ms FROM ev WHERE {where} GROUP BY 1")
    add(
        f"{prefix.replace('a10', 'a11')}_top_sql", lambda e, of=of: an.top_sql(of(e)),
        f"SELECT sql_text_hash, {SLOWEST} AS query, count(*) AS calls, sum(duration_us)::BIGINT / 1000.0{D} AS total_duration_ms, avg(duration_us) / 1000.0{D} AS avg_duration_ms, max(duration_us) / 1000.0{D} AS max_duration_ms,"
        f" sum(rows_read)::BIGINT AS total_rows FROM ev WHERE event_type = 'DBMSSQL' AND {where} GROUP BY 1 ORDER BY total_duration_ms DESC, 1 LIMIT 20",
    )
LINE = "SELECT id, ts, event_type, session_id, process_role, process_pid, duration_ms, sql_text, context FROM ev WHERE {}"
add("k7_operation_timeline", lambda e: an.timeline(an.of_operation(e, OPERATION)), LINE.format(OF_OP) + " ORDER BY ts DESC, id DESC LIMIT 50")
add("k7_session_timeline", lambda e: an.timeline(an.of_session(e, SESSION), 200, False), LINE.format(OF_SESSION) + " ORDER BY ts, id LIMIT 200")
add("k7_operation_exceptions", lambda e: an.exceptions(an.of_operation(e, "Doc.Op7.Module")), "SELECT id, ts, session_id, process_role, duration_ms, extra FROM ev WHERE event_type = 'EXCP' AND context_normalized = 'Doc.Op7.Module' ORDER BY ts DESC, id DESC LIMIT 30")
add("k7_list_deadlocks", an.list_deadlocks, "SELECT id, ts, session_id, process_role, process_pid, context_normalized, duration_ms, extra FROM ev WHERE event_type = 'TDEADLOCK' ORDER BY ts DESC, id DESC LIMIT 200")
DEAD = ", d AS (SELECT *, json_extract_string(extra, '$.Regions') AS rg, json_extract_string(extra, '$.WaitConnections') AS wc, json_extract_string(extra, '$.DeadlockConnectionIntersections') AS ix FROM ev WHERE event_type = 'TDEADLOCK')"
add("x15_regions", an.lock_regions, DEAD + ", r AS (SELECT id, trim(unnest(string_split(rg, ','))) AS raw FROM d) SELECT id, raw, regexp_extract(raw, '^(.*)\\s+(\\S+)$', 1) AS object_name, regexp_extract(raw, '(\\S+)$', 1) AS mode FROM r")
add("x16_waits", lambda e: an.deadlock_graphs(e).select("id", F.explode("waits").alias("connection")), DEAD + " SELECT id, trim(unnest(string_split(wc, ','))) AS connection FROM d")
add(
    "x17_edges", an.lock_edges,
    DEAD + ", p AS (SELECT id, regexp_extract_all(ix, '(\\S+)->([^|]+)', 1) AS w, regexp_extract_all(ix, '(\\S+)->([^|]+)', 2) AS r FROM d), q AS (SELECT id, w, r, unnest(range(1, len(w) + 1)) AS i FROM p)"
    " SELECT id, w[i] AS waiter, w[i % len(w) + 1] AS blocker, trim(r[i]) AS resource FROM q",
)
add(
    "u3_participants", lambda e: an.deadlock_graphs(e).select("id", F.array_join("participants", ",").alias("participants")),
    DEAD + ", p AS (SELECT id, unnest(list_concat([session_id::VARCHAR], string_split(wc, ','), regexp_extract_all(ix, '(\\S+)->', 1))) AS x FROM d) SELECT id, string_agg(DISTINCT x, ',' ORDER BY x) AS participants FROM p GROUP BY id",
)
add("f4_surrounding", lambda e: an.around(e, 500, 3600), ", c AS (SELECT ts FROM ev WHERE id = 500) SELECT id, ev.ts, event_type, session_id, process_role, process_pid, duration_ms, context_normalized FROM ev, c WHERE ev.ts BETWEEN c.ts - INTERVAL 3600 SECOND AND c.ts + INTERVAL 3600 SECOND AND id <> 500 ORDER BY ev.ts, id LIMIT 200")

SIDE = f"SELECT count(*){D} AS events_count, coalesce(sum(duration_us), 0)::BIGINT / 1000.0{D} AS total_duration_ms, coalesce(avg(duration_us) / 1000.0{D}, 0) AS avg_duration_ms, (count(*) FILTER (WHERE event_type = 'EXCP')){D} AS exceptions, (count(*) FILTER (WHERE event_type = 'TDEADLOCK')){D} AS deadlocks, (count(*) FILTER (WHERE event_type = 'TLOCK')){D} AS locks FROM ev WHERE archive_id = "
PAIRS = " UNION ALL ".join(f"SELECT '{m}' AS metric, a.{m} AS a, b.{m} AS b FROM a, b" for m in ("events_count", "total_duration_ms", "avg_duration_ms", "exceptions", "deadlocks", "locks"))
add("a13_compare_summary", lambda e: co.summary(e, "A", "B"), f", a AS ({SIDE}'A'), b AS ({SIDE}'B'), p AS ({PAIRS}) SELECT metric, a, b, b - a AS delta, CASE WHEN a <> 0 THEN round((b - a) * 100 / a, 2) END AS delta_percent FROM p")
TOP = f"SELECT sql_text_hash, {SLOWEST} AS query, count(*) AS calls, sum(duration_us)::BIGINT / 1000.0{D} AS total_ms, avg(duration_us) / 1000.0{D} AS avg_ms FROM ev WHERE event_type = 'DBMSSQL' AND archive_id = '%s' GROUP BY 1 ORDER BY total_ms DESC, 1 LIMIT 50"
TOPS = f", a AS ({TOP % 'A'}), b AS ({TOP % 'B'}), c AS (SELECT b.sql_text_hash, b.query, a.avg_ms AS a_avg_ms, b.avg_ms AS b_avg_ms, a.calls AS a_calls, b.calls AS b_calls, CASE WHEN a.avg_ms > 0 THEN round((b.avg_ms - a.avg_ms) * 100 / a.avg_ms, 2) ELSE 0.0 END AS delta_percent FROM a JOIN b ON a.sql_text_hash = b.sql_text_hash)"
add("a14_in_both", lambda e: co.common_statements(e, "A", "B"), TOPS + " SELECT * FROM c")
add("a14_regressed", lambda e: co.slower(co.common_statements(e, "A", "B")), TOPS + " SELECT * FROM c WHERE delta_percent >= 50")
add("a14_improved", lambda e: co.faster(co.common_statements(e, "A", "B")), TOPS + " SELECT * FROM c WHERE delta_percent <= -30")
add("a14_only_a", lambda e: co.only_in(e, "A", "B"), TOPS + " SELECT * FROM a WHERE sql_text_hash NOT IN (SELECT sql_text_hash FROM b)")
add("a14_only_b", lambda e: co.only_in(e, "B", "A"), TOPS + " SELECT * FROM b WHERE sql_text_hash NOT IN (SELECT sql_text_hash FROM a)")
LOAD = f"SELECT context_normalized AS operation, arg_max(context, row(duration_us, -id)) AS context, count(*) AS samples, round(quantile_cont(duration_us, 0.5) / 1000.0{D}, 3) AS p50, round(quantile_cont(duration_us, 0.95) / 1000.0{D}, 3) AS p95 FROM ev WHERE context_normalized <> '' AND duration_us > 0 AND %s GROUP BY 1"
add("a15_load_operations", co.load_operations, LOAD % "true")
SIG = "trim(operation) || '|' || substr(trim(regexp_replace(context, '\\s+', ' ', 'g')), 1, 200)"
REG = (
    f", a AS ({LOAD % "archive_id = 'A'"}), b AS ({LOAD % "archive_id = 'B'"}), a2 AS (SELECT {SIG} AS signature, * FROM a), b2 AS (SELECT {SIG} AS signature, * FROM b),"
    " j AS (SELECT coalesce(a2.signature, b2.signature) AS signature, coalesce(b2.operation, a2.operation) AS operation, a2.samples AS base_samples, a2.p50 AS base_p50, a2.p95 AS base_p95, b2.samples AS cur_samples, b2.p50 AS cur_p50, b2.p95 AS cur_p95 FROM a2 FULL JOIN b2 ON a2.signature = b2.signature),"
    " k AS (SELECT *, CASE WHEN base_samples IS NULL THEN 'new' WHEN cur_samples IS NULL THEN 'disappeared' WHEN cur_p95 / base_p95 >= 1.2 THEN 'regression' WHEN cur_p95 / base_p95 <= 1.0::DOUBLE / 1.2::DOUBLE THEN 'improvement' ELSE 'stable' END AS change_type FROM j)"
)
FIGURES = (
    "CASE WHEN base_samples > 0 AND cur_samples > 0 THEN round(cur_p95 / base_p95, 6) END AS p95_ratio, CASE WHEN cur_samples > 0 THEN round(cur_samples::DOUBLE / base_samples, 6) END AS count_ratio,"
    " round(CASE change_type WHEN 'new' THEN cur_p95 * ln(cur_samples + 1) WHEN 'disappeared' THEN base_p95 * ln(base_samples + 1) * 0.1 WHEN 'regression' THEN (cur_p95 / base_p95 - 1) * ln(cur_samples + 1) * cur_p95 ELSE 0 END, 3) AS priority_score,"
    " CASE WHEN least(base_samples, cur_samples) >= 20 THEN 'high' WHEN least(base_samples, cur_samples) >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM k WHERE coalesce(base_samples, 0) >= 5 OR coalesce(cur_samples, 0) >= 5"
)


def regressions(events, **more):
    a, b = (co.load_operations(co.archive(events, x)) for x in "AB")
    return co.regressions(a, b, 1.2, **more)


def rounded(rows):
    return rows.withColumns({"priority_score": F.round("priority_score", 3), "p95_ratio": F.round("p95_ratio", 6), "count_ratio": F.round("count_ratio", 6)})


add("a16_regressions", lambda e: rounded(regressions(e)), REG + f" SELECT *, {FIGURES}")
add(
    "a16_first_of_each_class", lambda e: rounded(regressions(e, top_n=2)),
    REG + f", f AS (SELECT *, {FIGURES}) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY change_type ORDER BY CASE WHEN change_type = 'improvement' THEN p95_ratio ELSE -priority_score END, signature) <= 2",
)
add("a16_change_counts", lambda e: co.change_counts(regressions(e)), REG + " SELECT change_type, count(*) AS n FROM k WHERE coalesce(base_samples, 0) >= 5 OR coalesce(cur_samples, 0) >= 5 GROUP BY 1")
add("a16_matched", lambda e: co.matched_count(*(co.load_operations(co.archive(e, x)) for x in "AB")), REG + " SELECT count(*) AS total_operations_matched FROM k WHERE base_samples IS NOT NULL AND cur_samples IS NOT NULL")
ALL = "id, ts, event_type, duration_us, session_id, user_name, context"
add("k2_first_100", lambda e: vi.preset(e, "first_100"), f"SELECT {ALL}, sql_text FROM ev ORDER BY ts, id LIMIT 100")
add("k2_longest", lambda e: vi.preset(e, "longest"), f"SELECT {ALL}, sql_text FROM ev WHERE own_us IS NOT NULL ORDER BY duration_us DESC NULLS LAST, id LIMIT 100")
add("k2_deadlocks", lambda e: vi.preset(e, "deadlocks"), f"SELECT {ALL} FROM ev WHERE event_type = 'TDEADLOCK' ORDER BY ts, id LIMIT 100")
add("k3_plan_page", lambda e: vi.plan_page(e, "mssql", 50, 10), "SELECT id AS event_id, ts, duration_us, substr(sql_text, 1, 200) AS sql_preview, length(plan_text)::INT AS plan_size, context, engine FROM ev WHERE plan_text <> '' AND engine = 'mssql' ORDER BY duration_us DESC, ts DESC, id LIMIT 50 OFFSET 10")
add("k10_event", lambda e: vi.event(e, 42).select("id", "ts", "event_type"), "SELECT id, ts, event_type FROM ev WHERE id = 42")
add("a17_plan_counts", vi.plan_counts, "SELECT coalesce(engine, 'unknown') AS engine, count(*) AS n FROM ev WHERE plan_text <> '' GROUP BY 1")
add("f9_containing", lambda e: fi.containing(e.select("id", "event_type", "context"), "op17"), "SELECT id, event_type, context FROM ev WHERE contains(lower(id::VARCHAR), 'op17') OR contains(lower(event_type), 'op17') OR contains(lower(context), 'op17')")
MS = "sum(duration_us)::BIGINT / 1000.0::DOUBLE AS total_ms, avg(duration_us) / 1000.0::DOUBLE AS avg_ms"
TEMPLATE_SQL = {
    "top_slow_sql": f"SELECT {SLOWEST} AS query, count(*) AS calls, {MS}, max(duration_us) / 1000.0::DOUBLE AS max_ms FROM ev WHERE event_type = 'DBMSSQL' AND sql_text_hash IS NOT NULL GROUP BY sql_text_hash ORDER BY total_ms DESC NULLS LAST, sql_text_hash LIMIT 100",
    "long_server_calls": "SELECT ts, process_role, context, duration_us / 1000.0::DOUBLE AS duration_ms FROM ev WHERE event_type IN ('CALL', 'SCALL') AND duration_us > 10000000 ORDER BY duration_us DESC, id LIMIT 100",
    "top_contexts_slow": f"SELECT context, count(*) AS calls, {MS} FROM ev WHERE context IS NOT NULL GROUP BY context ORDER BY total_ms DESC NULLS LAST, context LIMIT 50",
    "deadlocks_by_hour": "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS deadlocks FROM ev WHERE event_type = 'TDEADLOCK' GROUP BY hour ORDER BY hour",
    "locks_top_resources": "SELECT json_extract_string(extra, '$.Regions') AS resource, count(*) AS lock_events FROM ev WHERE event_type = 'TLOCK' GROUP BY resource ORDER BY lock_events DESC, resource LIMIT 50",
    "lock_wait_sessions": "SELECT ts, session_id, user_name, json_extract_string(extra, '$.WaitConnections') AS wait_for FROM ev WHERE event_type = 'TLOCK' AND json_extract_string(extra, '$.WaitConnections') IS NOT NULL ORDER BY ts DESC, id DESC LIMIT 100",
    "exceptions_feed": "SELECT ts, process_role, context, json_extract_string(extra, '$.Exception') AS exception, json_extract_string(extra, '$.Descr') AS description FROM ev WHERE event_type = 'EXCP' ORDER BY ts DESC, id DESC LIMIT 200",
    "errors_by_type": "SELECT json_extract_string(extra, '$.Exception') AS exception_type, count(*) AS cnt FROM ev WHERE event_type = 'EXCP' GROUP BY exception_type ORDER BY cnt DESC, exception_type LIMIT 50",
    "memory_heavy_events": "SELECT ts, event_type, process_role, context, json_extract_string(extra, '$.Memory') AS memory, json_extract_string(extra, '$.MemoryPeak') AS memory_peak FROM ev WHERE json_extract(extra, '$.MemoryPeak') IS NOT NULL"
    " ORDER BY json_extract_string(extra, '$.MemoryPeak')::BIGINT DESC, id LIMIT 100",
    "events_by_role_and_type": "SELECT process_role, event_type, count(*) AS cnt FROM ev GROUP BY process_role, event_type",
    "activity_by_hour": "SELECT hour(ts)::INT AS hour_of_day, count(*) AS events, sum(duration_us)::BIGINT / 1000.0::DOUBLE AS total_ms, count(*) FILTER (WHERE event_type = 'EXCP') AS exceptions FROM ev GROUP BY hour_of_day",
    "sessions_overview": "SELECT session_id, user_name, count(*) AS events, sum(duration_us)::BIGINT / 1000.0::DOUBLE AS total_ms, min(ts) AS first_event, max(ts) AS last_event, count(DISTINCT context) AS unique_contexts FROM ev"
    " WHERE session_id IS NOT NULL GROUP BY session_id, user_name ORDER BY total_ms DESC NULLS LAST, session_id, user_name LIMIT 100",
    "events_count_overview": "SELECT event_type, count(*) AS cnt, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percent FROM ev GROUP BY event_type",
}
for number, name in enumerate(te.TEMPLATES, 1):
    add(f"qt{number}_{name}", lambda e, name=name: te.template(e, name), TEMPLATE_SQL[name])
add(
    "a18_usage_summary", lambda e: us.tops(e, {"event_type": 5, "process_role": 3, "user_name": 10}),
    ", c AS (SELECT 'event_type' AS kind, event_type AS value, count(*) AS n, 5 AS most FROM ev GROUP BY 2 UNION ALL SELECT 'process_role', process_role, count(*), 3 FROM ev GROUP BY 2 UNION ALL SELECT 'user_name', user_name, count(*), 10 FROM ev GROUP BY 2)"
    " SELECT kind, value, n FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) <= most",
)
add("a19_monthly_usage", lambda e: us.remaining(us.monthly_usage(e, "user_name", "ts", "event_type"), 5), ", u AS (SELECT user_name AS \"user\", date_trunc('month', ts)::TIMESTAMP AS month, event_type AS kind, count(*) AS used FROM ev GROUP BY 1, 2, 3) SELECT *, greatest(5 - used, 0) AS remaining FROM u")
add("a25_json_keys", us.json_keys, ", p AS (SELECT event_type, unnest(json_keys(extra)) AS key, extra FROM ev WHERE extra IS NOT NULL), v AS (SELECT event_type, key, json_extract_string(extra, '$.' || key) AS value FROM p) SELECT event_type, key, count(*) AS n, count(*) FILTER (WHERE try_cast(value AS DOUBLE) IS NOT NULL) AS numbers, min(value) AS least FROM v GROUP BY 1, 2")
add("a26_composition", us.composition, "SELECT event_type, count(*) AS n, count(sql_text) AS with_sql, count(plan_text) AS with_plan, count(engine) AS with_engine FROM ev GROUP BY 1")
add("a26_slowest_composition", us.slowest_composition, ", s AS (SELECT event_type FROM ev ORDER BY duration_us DESC NULLS LAST, id LIMIT 200) SELECT event_type, count(*) AS n FROM s GROUP BY 1")
add("a29_shares", us.shares, f"SELECT context_normalized AS operation, coalesce(sum(CASE WHEN event_type = 'DBMSSQL' THEN duration_us ELSE 0 END){D} / nullif(sum(duration_us), 0){D}, 0) AS sql_share, (count(*) FILTER (WHERE event_type IN ('TLOCK', 'TDEADLOCK'))){D} / count(*) AS lock_share FROM ev WHERE context_normalized IS NOT NULL GROUP BY 1")
add("w5_hour_load", us.hour_load, "SELECT id, session_id, count(*) OVER (PARTITION BY session_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_the_hour FROM ev")
add(
    "w4_islands", lambda e: us.islands(e.select("session_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.col("duration_us") * 100).alias("e")), ["session_id"], "s", "e"),
    ", r AS (SELECT session_id, epoch_us(ts) AS s, epoch_us(ts) + duration_us * 100 AS e FROM ev), m AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s THEN 0 ELSE 1 END AS n FROM r),"
    " g AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM m) SELECT session_id, min(s) AS start, max(e) AS \"end\", count(*) AS n FROM g GROUP BY session_id, grp",
)
add(
    "w4_groups", lambda e: us.range_groups(e.select("session_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.col("duration_us") * 100).alias("e"), F.expr("element_at(array('Info', 'Major', 'Critical'), cast(id % 3 + 1 as int))").alias("severity"), F.expr("concat('c', id % 5)").alias("code")), ["session_id"], "s", "e", ("Critical", "Major", "Info")),
    ", r AS (SELECT session_id, epoch_us(ts) AS s, epoch_us(ts) + duration_us * 100 AS e, 2 - id % 3 AS rank, 'c' || (id % 5) AS code FROM ev), m AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s THEN 0 ELSE 1 END AS n FROM r),"
    " g AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM m), c AS (SELECT session_id, grp, string_agg(code, ',' ORDER BY rank, code) AS codes FROM (SELECT DISTINCT session_id, grp, rank, code FROM g) GROUP BY ALL)"
    " SELECT session_id, min(s) AS start, max(e) AS \"end\", ['Critical', 'Major', 'Info'][min(rank) + 1] AS severity, any_value(codes) AS codes FROM g JOIN c USING (session_id, grp) GROUP BY session_id, grp",
)
add("a18_overall", lambda e: us.overall(e, "process_pid"), "SELECT count(*) AS total, count(DISTINCT process_pid) AS devices FROM ev")
add(
    "a19_month_summary", lambda e: us.month_summary(e, "user_name", "ts", "process_pid", F.col("event_type") != "EXCP", F.when(F.col("id") % 3 == 0, "paid").otherwise("free")),
    "SELECT user_name AS \"user\", date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS used, count(DISTINCT process_pid) AS devices, count(*) FILTER (WHERE id % 3 <> 0) AS free, count(*) FILTER (WHERE id % 3 = 0) AS paid FROM ev WHERE event_type <> 'EXCP' GROUP BY 1, 2",
)
add(
    "a21_cache_stats", lambda e: us.cache_stats(e.select(F.col("event_type").alias("kind"), F.concat(F.lit("k"), "id").alias("key"), (F.col("duration_us") % 1000).alias("size"), (F.col("duration_us") % 37).alias("hits"), F.col("ts").alias("at")), 3),
    ", c AS (SELECT event_type AS kind, 'k' || id AS key, duration_us % 1000 AS size, duration_us % 37 AS hits, ts AS made FROM ev), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY hits DESC, key) <= 3), u AS (SELECT kind, string_agg(key, ',' ORDER BY hits DESC, key) AS most_used FROM b GROUP BY 1)"
    " SELECT kind, count(*) AS n, sum(size)::BIGINT AS bytes, sum(hits)::BIGINT AS hits, min(made) AS oldest, max(made) AS newest, any_value(most_used) AS most_used FROM c JOIN u USING (kind) GROUP BY kind",
)
MIXED = "CASE WHEN id % 4 = 0 THEN concat('{\"a\":', id % 7, ',\"b\":\"x', id % 5, '\"}') WHEN id % 4 = 1 THEN '{\"a\":\"t\",\"b\":[1,2]}' WHEN id % 4 = 2 THEN '{\"a\":true,\"b\":{\"c\":1}}' END"
add(
    "a25_json_profile", lambda e: us.json_profile(e.select("event_type", F.expr(MIXED).alias("extra"))),
    f", x AS (SELECT event_type, {MIXED.replace('concat', 'concat')} AS extra FROM ev), p AS (SELECT event_type, unnest(['a', 'b']) AS key, extra FROM x WHERE extra IS NOT NULL),"
    " v AS (SELECT event_type, key, CASE json_type(extra, '$.' || key) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind, json_extract_string(extra, '$.' || key) AS text FROM p),"
    " d AS (SELECT event_type, key, kind, text, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, key, kind ORDER BY text) AS i FROM d)"
    " SELECT event_type, key, kind, sum(n)::BIGINT AS n, string_agg(text, '|' ORDER BY text) FILTER (WHERE i <= 3) AS samples FROM r GROUP BY ALL",
)
BROKEN = "CASE id % 4 WHEN 0 THEN extra WHEN 1 THEN concat('[1,', id, ']') WHEN 2 THEN concat(repeat('x', 250), id) END"
add("x18_problems", lambda e: e.select("id", deadlocks.problem(F.expr(BROKEN)).alias("problem")), f"SELECT id, CASE WHEN id % 4 IN (1, 2) THEN substr({BROKEN}, 1, 200) END AS problem FROM ev")
PLAN_TEXT = "concat('Limit  (cost=0.00..', id, '.5 rows=', id, ' width=8) (actual time=0.1..2.5 rows=10 loops=', id % 3, ')\n  ->  Nested Loop  (cost=0.00..2.00 rows=1 width=4)\n        Join Filter: (a = b)\n        Rows Removed by Filter: ', id * 10, '\n        ->  Seq Scan on t', id, '  (cost=0.00..1.00 rows=1 width=4) (never executed)\n        ->  Index Only Scan using i on d  (cost=0.00..1.00 rows=1 width=4)\n              Heap Fetches: ', id % 2, '\n              Buffers: shared hit=1\n  Workers Planned: 2\nPlanning Time: 0.5 ms\nsomething else')"
add(
    "x38_plan_lines", lambda e: plan_lines.annotated(e.select("id", F.expr(PLAN_TEXT).alias("plan_text"))),
    ", l(n, depth, kind, name, never) AS (VALUES (1, 0, 'node', 'Limit', false), (2, 6, 'node', 'Nested Loop', false), (3, NULL, 'condition', 'Join Filter', NULL), (4, NULL, 'removed', NULL, NULL), (5, 12, 'node', 'Seq Scan', true), (6, 12, 'node', 'Index Only Scan', false), (7, NULL, 'heap_fetches', NULL, NULL), (8, NULL, 'buffers', NULL, NULL), (9, NULL, 'workers', NULL, NULL), (10, NULL, 'timing', 'Planning Time', NULL), (11, NULL, 'other', NULL, NULL))"
    " SELECT id, n, depth, kind, name, CASE n WHEN 1 THEN id + 0.5::DOUBLE WHEN 2 THEN 2.0::DOUBLE WHEN 5 THEN 1.0::DOUBLE WHEN 6 THEN 1.0::DOUBLE END AS cost, CASE WHEN n = 1 THEN id WHEN n IN (2, 5, 6) THEN 1 END AS rows_expected,"
    " CASE n WHEN 1 THEN 10.0::DOUBLE END AS rows_met, CASE n WHEN 1 THEN id % 3 END AS loops, never, CASE n WHEN 3 THEN '(a = b)' WHEN 4 THEN (id * 10)::VARCHAR WHEN 7 THEN (id % 2)::VARCHAR WHEN 9 THEN '2' WHEN 10 THEN '0.5' END AS value,"
    " coalesce((n = 4 AND id * 10 >= 1000) OR (n = 7 AND id % 2 > 0), false) AS flagged FROM ev, l",
)
add(
    "x38_parents", lambda e: plan_lines.parents(plan_lines.annotated(e.select("id", F.expr(PLAN_TEXT).alias("plan_text")))),
    ", l(n, parent) AS (VALUES (1, NULL), (2, 1), (5, 2), (6, 2)) SELECT id, n, parent FROM ev, l",
)
add("k11_chips", lambda e: vi.in_chip_order(vi.type_counts(e)).limit(3), "SELECT event_type, count(*) AS n FROM ev WHERE event_type IN ('TDEADLOCK', 'EXCP', 'EXCPCNTX') GROUP BY 1")
add(
    "k6_sorted_cells", lambda e: vi.sorted_cells(e.select("id", F.expr("CASE id % 3 WHEN 0 THEN concat(id % 50, ',5') WHEN 1 THEN concat('b', id % 7) END").alias("cell")), "cell").limit(200),
    ", c AS (SELECT id, CASE id % 3 WHEN 0 THEN (id % 50) || ',5' WHEN 1 THEN 'b' || (id % 7) END AS cell FROM ev) SELECT id, cell FROM c ORDER BY cell IS NULL, try_cast(replace(cell, ',', '.') AS DOUBLE) NULLS LAST, cell, id LIMIT 200",
)
add("f10_postgres_plans", lambda e: vi.plan_page(e, "postgres", 20).select("event_id", "engine"), "SELECT id AS event_id, engine FROM ev WHERE plan_text <> '' AND engine = 'postgres' ORDER BY duration_us DESC, ts DESC, id LIMIT 20")

"""Console statements in DuckDB's forms: the same text is the query, rewritten for Spark, and its SQL."""

from __future__ import annotations

from ..sources.console import console

STATEMENTS = {
    "c7_arg_max": "SELECT user_id, arg_max(event_id, value) AS top, arg_min(event_id, value) AS low FROM events GROUP BY user_id",
    "c7_quantiles": "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "c7_json": "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract(props, '$.k')::VARCHAR AS b, props->>'$.k' AS c FROM events",
    "c7_times": "SELECT event_id, extract(epoch FROM ts) AS seconds, epoch_ms(ts) AS ms, extract(dow FROM ts)::BIGINT AS dow, extract(isodow FROM ts)::BIGINT AS isodow, date_trunc('hour', ts) AS hour, strftime(ts, '%Y-%m-%d %H:%M:%S at day %j') AS said FROM events",
    "c7_casts": "SELECT event_id, event_id::varchar AS a, CAST(user_id AS VARCHAR) || '::varchar' AS b, event_id / 1000.0 AS c, event_id // 7 AS d FROM events",
    "c7_strings": "SELECT event_id, regexp_matches(event_type, '^p') AS a, regexp_extract(event_type, '[aeiou]+') AS b, strlen(event_type)::BIGINT AS c, string_split('a.b' || event_type, '.')[1] AS d FROM events",
    "c7_exclude": "SELECT * EXCLUDE (props, ts) FROM events WHERE event_type <> 'QUALIFY x'",
    "c7_qualify": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n FROM events WHERE value > 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 2 AND event_id > 5",
    "c7_qualify_inside": "WITH x AS (SELECT DISTINCT user_id, event_type FROM events QUALIFY rank() OVER (PARTITION BY event_type ORDER BY value DESC) = 1) SELECT event_type, count(*) AS n FROM x GROUP BY event_type UNION ALL SELECT 'all', count(*) FROM (SELECT event_id FROM events QUALIFY event_id = max(event_id) OVER (PARTITION BY user_id)) y",
    "c7_as_of": "SELECT p.event_id AS event_id, p.user_id AS user_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'click') AS c ON p.user_id = c.user_id AND p.ts >= c.ts",
    "c7_as_of_inner": "SELECT p.event_type AS event_type, count(*) AS n, max(c.ts) AS last FROM events p ASOF JOIN (SELECT user_id, ts FROM events WHERE event_type = 'click') c ON c.user_id = p.user_id AND c.ts < p.ts WHERE p.value > 1 GROUP BY p.event_type",
}


def _ask(sql: str):
    return lambda spark, sf_dir: console(spark, sql, {"events": spark.read.parquet(f"{sf_dir}/events.parquet")}, dialect="duckdb")


QUERIES = {k: _ask(sql) for k, sql in STATEMENTS.items()}
ORACLES = STATEMENTS

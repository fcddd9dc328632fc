"""Queries of the mergeable summaries and of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import EV, log_events
from ..operators import sketches as sk
from ..streaming import follow


def _hours(s, d):
    return sk.hourly(log_events(s, d))


def _within(s, d):
    """Of each operation whether the estimates from merged hours are as near as stated; a few samples allow no closer rank than one of them."""
    events = log_events(s, d)
    off = sk.outside(sk.merged(sk.hourly(events), "operation"), events)
    near = lambda c: F.col(c) <= sk.RANK_ERROR + 1 / F.col("samples")
    return off.select("operation", "samples", near("p50_off").alias("p50_near"), near("p95_off").alias("p95_near"))


def _sessions_within(s, d):
    found = sk.figures(sk.merged(_hours(s, d), "archive_id"))
    exact = log_events(s, d).where("context_normalized <> '' AND duration_us > 0").groupBy("archive_id").agg(F.count_distinct("session_id").alias("exact"))
    near = F.abs(F.col("sessions") - F.col("exact")) <= 4 * sk.DISTINCT_ERROR * F.col("exact")
    return found.join(exact, "archive_id").select("archive_id", "samples", "exact", near.alias("near"))


def _sessions(s, d):
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(f"{c}_at")
    return follow.sessions(log_events(s, d), "12 hours").select("session_id", ntz("start"), ntz("end"), "events", "own_us", "errors")


QUERIES = {
    "sk_hourly_sums": lambda s, d: sk.figures(_hours(s, d)).select("archive_id", "hour", "operation", "samples", "total_ms", "slowest_ms"),
    "sk_merged_sums": lambda s, d: sk.figures(sk.merged(sk.merged(_hours(s, d), "archive_id", "operation"), "operation")).select("operation", "samples", "total_ms", "slowest_ms"),
    "sk_quantiles_near": _within,
    "sk_sessions_near": _sessions_within,
    "sk_compared": lambda s, d: sk.compared(_hours(s, d), "A", "B").select("operation", "base_samples", "cur_samples", (F.col("ratio") > 0).alias("has_ratio")),
    "st4_sessions": _sessions,
}
USED = "context_normalized <> '' AND duration_us > 0"
ORACLES = {
    "sk_hourly_sums": EV + f"SELECT archive_id, date_trunc('hour', ts) AS hour, context_normalized AS operation, count(*) AS samples, sum(duration_us)::BIGINT / 1000.0::DOUBLE AS total_ms, max(duration_us) / 1000.0::DOUBLE AS slowest_ms FROM ev WHERE {USED} GROUP BY ALL",
    "sk_merged_sums": EV + f"SELECT context_normalized AS operation, count(*) AS samples, sum(duration_us)::BIGINT / 1000.0::DOUBLE AS total_ms, max(duration_us) / 1000.0::DOUBLE AS slowest_ms FROM ev WHERE {USED} GROUP BY ALL",
    "sk_quantiles_near": EV + f"SELECT context_normalized AS operation, count(*) AS samples, true AS p50_near, true AS p95_near FROM ev WHERE {USED} GROUP BY ALL",
    "sk_sessions_near": EV + f"SELECT archive_id, count(*) AS samples, count(DISTINCT session_id) AS exact, true AS near FROM ev WHERE {USED} GROUP BY ALL",
    "sk_compared": EV + f"SELECT context_normalized AS operation, nullif(count(*) FILTER (WHERE archive_id = 'A'), 0) AS base_samples, nullif(count(*) FILTER (WHERE archive_id = 'B'), 0) AS cur_samples, CASE WHEN count(DISTINCT archive_id) = 2 THEN true END AS has_ratio FROM ev WHERE {USED} GROUP BY ALL",
    "st4_sessions": EV + ", n AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY session_id ORDER BY ts) + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM ev WHERE session_id IS NOT NULL),"
    " g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM n)"
    " SELECT session_id, min(ts) AS start_at, max(ts) + INTERVAL 12 HOURS AS end_at, count(*) AS events, sum(own_us)::BIGINT AS own_us, count(*) FILTER (WHERE event_type IN ('EXCP', 'EXCPCNTX')) AS errors FROM g GROUP BY session_id, g",
}

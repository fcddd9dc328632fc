"""One operation, one session or one deadlock, looked at closely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import deadlocks
from .filters import SQL_TYPES, count_of, ms, names, of_types, own_us
from .views import slowest_text, statements


def of_operation(events: DataFrame, operation: str) -> DataFrame:
    return events.where(F.col("context_normalized") == operation)


def of_session(events: DataFrame, session_id: int) -> DataFrame:
    return events.where(F.col("session_id") == session_id)


def wall_clock() -> Column:
    return F.expr("timestampdiff(MICROSECOND, min(ts), max(ts)) / 1000D")


def operation_summary(events: DataFrame, sql_types=SQL_TYPES) -> DataFrame:
    """One row, also for an operation that never ran; the minimum leaves zeros out."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"), ms(F.coalesce(F.sum(own_us()), F.lit(0))).alias("total_duration_ms"), ms(F.avg(own_us())).alias("avg_duration_ms"),
        ms(F.max(own_us())).alias("max_duration_ms"), ms(F.min(F.nullif(own_us(), F.lit(0)))).alias("min_duration_ms"), F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("process_pid").alias("unique_processes"), names("process_role").alias("process_roles"), count_of("EXCP").alias("exception_count"),
        count_of("TLOCK", "TDEADLOCK").alias("lock_count"), count_of(*sql_types).alias("sql_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), wall_clock().alias("wall_clock_ms"),
    ).withColumn("found", F.col("total_events") > 0)


def session_summary(events: DataFrame, sql_types=SQL_TYPES) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("total_events"), names("user_name").alias("users"), names("process_role").alias("process_roles"), names("process_pid").alias("process_pids"),
        F.count_distinct("context_normalized").alias("distinct_operations"), ms(F.coalesce(F.sum(own_us()), F.lit(0))).alias("total_duration_ms"), count_of("EXCP").alias("exception_count"),
        count_of("TLOCK", "TDEADLOCK").alias("lock_count"), count_of(*sql_types).alias("sql_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), wall_clock().alias("wall_clock_ms"),
    ).withColumn("found", F.col("total_events") > 0)


def breakdown(events: DataFrame) -> DataFrame:
    """By event type, with durations that repeat the parent's (the summary leaves these out)."""
    us = F.col("duration_us")
    out = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), ms(F.sum(us)).alias("total_duration_ms"), ms(F.avg(us)).alias("avg_duration_ms"))
    return out.orderBy(F.col("total_duration_ms").desc_nulls_last(), F.col("events").desc(), "event_type")


def top_sql(events: DataFrame, limit: int = 20, types=SQL_TYPES) -> DataFrame:
    us = F.coalesce("duration_us", F.lit(0))
    out = statements(events, types).groupBy("sql_text_hash").agg(
        slowest_text().alias("query"), F.count(F.lit(1)).alias("calls"), ms(F.sum(us)).alias("total_duration_ms"), ms(F.avg(us)).alias("avg_duration_ms"),
        ms(F.max(us)).alias("max_duration_ms"), F.sum("rows_read").alias("total_rows"),
    )
    return out.orderBy(F.col("total_duration_ms").desc_nulls_last(), "sql_text_hash").limit(limit)


def timeline(events: DataFrame, limit: int = 50, newest_first: bool = True) -> DataFrame:
    order = [F.col("ts").desc(), F.col("id").desc()] if newest_first else ["ts", "id"]
    return events.select("id", "ts", "event_type", "session_id", "process_role", "process_pid", ms(F.col("duration_us")).alias("duration_ms"), "sql_text", "context").orderBy(*order).limit(limit)


def exceptions(events: DataFrame, limit: int = 30) -> DataFrame:
    return of_types(events, ("EXCP",)).select("id", "ts", "session_id", "process_role", ms(F.col("duration_us")).alias("duration_ms"), "extra").orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def list_deadlocks(events: DataFrame, limit: int = 200) -> DataFrame:
    return (
        of_types(events, ("TDEADLOCK",)).select("id", "ts", "session_id", "process_role", "process_pid", "context_normalized", ms(F.col("duration_us")).alias("duration_ms"), "extra")
        .orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)
    )


def deadlock_graphs(events: DataFrame) -> DataFrame:
    """All deadlocks with their regions, waiting connections, edges and participants, as arrays."""
    extra = F.col("extra")
    rows = of_types(events, ("TDEADLOCK",)).withColumns({"regions": deadlocks.regions(extra), "waits": deadlocks.waits(extra), "edges": deadlocks.edges(extra)})
    return rows.select("id", "ts", "session_id", "regions", "waits", "edges", deadlocks.participants(F.col("session_id"), F.col("waits"), F.col("edges")).alias("participants"))


def lock_edges(events: DataFrame) -> DataFrame:
    return deadlock_graphs(events).select("id", F.explode("edges").alias("e")).select("id", "e.*")


def lock_regions(events: DataFrame) -> DataFrame:
    return deadlock_graphs(events).select("id", F.explode("regions").alias("r")).select("id", "r.*")


def around(events: DataFrame, id_: int, seconds: int = 30, limit: int = 200) -> DataFrame:
    """What happened within some seconds of an event; its time is a scalar that Spark looks up once."""
    centre = F.broadcast(events.where(F.col("id") == id_).limit(1).select(F.col("ts").alias("_at")))
    span = F.make_dt_interval(secs=F.lit(seconds))
    near = events.join(centre, (F.col("ts") >= F.col("_at") - span) & (F.col("ts") <= F.col("_at") + span)).where(F.col("id") != id_)
    return near.select("id", "ts", "event_type", "session_id", "process_role", "process_pid", ms(F.col("duration_us")).alias("duration_ms"), "context_normalized").orderBy("ts", "id").limit(limit)

"""Rankings, time lines and histograms over ``events``. Every limit is that of a report; ties go by the last column named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from .filters import SQL_TYPES, by_context, count_of, ms, names, of_types, own_us

SLOW_ORDERS = {"total_duration": "total_duration_ms", "avg_duration": "avg_duration_ms", "max_duration": "max_duration_ms", "count": "calls"}
OPERATION_ORDERS = {
    "total_duration": "total_duration_ms", "avg_duration": "avg_duration_ms", "max_duration": "max_duration_ms", "count": "calls", "sql_duration": "sql_duration_ms",
    "locks": "lock_events", "exceptions": "exception_events",
}
# The histogram's bounds in microseconds.
BUCKETS = [("<1ms", 0, 1_000), ("1-10ms", 1_000, 10_000), ("10-100ms", 10_000, 100_000), ("100ms-1s", 100_000, 1_000_000), ("1-10s", 1_000_000, 10_000_000), ("10-60s", 10_000_000, 60_000_000), (">60s", 60_000_000, None)]


def slowest_text() -> Column:
    """The text of the slowest call; of equally slow ones the one with the smallest id."""
    text = F.coalesce("sql_text", "sql_text_normalized")
    return F.max_by(text, F.when(text.isNotNull(), F.struct(F.coalesce("duration_us", F.lit(0)), -F.col("id"))))


def statements(events: DataFrame, types=SQL_TYPES) -> DataFrame:
    return of_types(events, types).where("sql_text_normalized is not null")


def statement_figures(grouped: GroupedData) -> DataFrame:
    us = F.col("duration_us")
    return grouped.agg(
        slowest_text().alias("query"), F.count(F.lit(1)).alias("calls"), ms(F.sum(us)).alias("total_duration_ms"), ms(F.avg(us)).alias("avg_duration_ms"),
        ms(F.max(us)).alias("max_duration_ms"), F.sum(F.coalesce("rows_read", F.lit(0))).alias("total_rows_read"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), names("process_role").alias("process_roles"),
    )


def slow_queries(events: DataFrame, sort_by: str = "total_duration", limit: int = 100, types=SQL_TYPES) -> DataFrame:
    """Statements by their literal-free text, the costliest first; partial sums before one shuffle on the hash."""
    figures = statement_figures(statements(events, types).groupBy("sql_text_hash"))
    return figures.orderBy(F.col(SLOW_ORDERS.get(sort_by, "total_duration_ms")).desc_nulls_last(), "sql_text_hash").limit(limit)


def slow_queries_total(events: DataFrame, types=SQL_TYPES) -> DataFrame:
    """total_rows: how many statements there are beyond the report's limit too."""
    return statements(events, types).agg(F.count_distinct("sql_text_hash").alias("total_rows"))


def time_unit(since=None, until=None) -> str:
    """minute for spans under 2 hours, hour for spans under 2 days, day beyond; hour where the span isn't known."""
    if not since or not until:
        return "hour"
    seconds = (until - since).total_seconds()
    return "minute" if seconds < 2 * 3600 else "hour" if seconds < 2 * 86400 else "day"


def bucket(unit: str, ts: str = "ts") -> Column:
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def locks_timeline(events: DataFrame, unit: str = "hour", limit: int = 5000) -> DataFrame:
    """Locks and deadlocks by time; times without any don't appear."""
    rows = of_types(events, ("TLOCK", "TDEADLOCK"))
    return rows.groupBy(bucket(unit).alias("bucket")).agg(count_of("TLOCK").alias("locks"), count_of("TDEADLOCK").alias("deadlocks")).orderBy("bucket").limit(limit)


def process_roles(events: DataFrame) -> DataFrame:
    return (
        events.where("process_role is not null").groupBy("process_role")
        .agg(F.count(F.lit(1)).alias("events_count"), ms(F.sum(own_us())).alias("total_duration_ms"), F.count_distinct("process_pid").alias("unique_processes"), ms(F.avg(own_us())).alias("avg_duration_ms"))
        .orderBy(F.col("events_count").desc(), "process_role")
    )


def duration_histogram(events: DataFrame) -> DataFrame:
    """The seven buckets in order, empty ones too. One row of conditional counts is made and turned into rows."""
    us = own_us()
    rows = events.where("duration_us is not null").where(us.isNotNull()).select(us.alias("us"))
    inside = [(F.col("us") >= lo) & (F.lit(True) if hi is None else F.col("us") < hi) for _, lo, hi in BUCKETS]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(x).alias(f"c{i}") for i, x in enumerate(inside)))
    cells = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(b[0]).alias("label"), F.col(f"c{i}").alias("count")) for i, b in enumerate(BUCKETS)))
    percent = F.when(F.col("n") > 0, F.round(F.col("b.count") * F.lit(100.0) / F.col("n"), 2)).otherwise(0.0)
    return one.select("n", F.explode(cells).alias("b")).select("b.position", "b.label", "b.count", percent.alias("percent"))


def events_feed(events: DataFrame, types=(), presence: str | None = None, limit: int = 500) -> DataFrame:
    rows = by_context(of_types(events, types), presence)
    return rows.select("id", "ts", "event_type", "process_role", "process_pid", "context", ms(F.col("duration_us")).alias("duration_ms"), "extra").orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def events_feed_total(events: DataFrame, types=(), presence: str | None = None) -> DataFrame:
    return by_context(of_types(events, types), presence).agg(F.count(F.lit(1)).alias("total_rows"))


def type_counts(events: DataFrame, limit: int = 200) -> DataFrame:
    return events.where("event_type is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "event_type").limit(limit)


def operations(events: DataFrame, types=(), sql_types=SQL_TYPES) -> DataFrame:
    """Business operations by their context, with durations, locks, exceptions and who ran them."""
    sql = F.when(F.col("event_type").isin(*sql_types), F.coalesce("duration_us", F.lit(0))).otherwise(0)
    return of_types(events, types).where("context_normalized <> ''").groupBy(F.col("context_normalized").alias("operation")).agg(
        F.count(F.lit(1)).alias("calls"), ms(F.sum(own_us())).alias("total_duration_ms"), ms(F.avg(own_us())).alias("avg_duration_ms"), ms(F.max(own_us())).alias("max_duration_ms"),
        ms(F.sum(sql)).alias("sql_duration_ms"), count_of("TLOCK", "TDEADLOCK").alias("lock_events"), count_of("EXCP").alias("exception_events"),
        F.count_distinct("session_id").alias("unique_sessions"), names("process_role").alias("process_roles"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )


def top_operations(events: DataFrame, sort_by: str = "total_duration", types=(), limit: int = 100, sql_types=SQL_TYPES) -> DataFrame:
    return operations(events, types, sql_types).orderBy(F.col(OPERATION_ORDERS.get(sort_by, "total_duration_ms")).desc_nulls_last(), "operation").limit(limit)


def operations_total(events: DataFrame, types=()) -> DataFrame:
    return of_types(events, types).where("context_normalized <> ''").agg(F.count_distinct("context_normalized").alias("total_rows"))


# Event types by how bad they are; the report's chips are in this order, other types follow by name.
CHIPS = ("TDEADLOCK", "TTIMEOUT", "EXCP", "EXCPCNTX", "TLOCK")


def in_chip_order(rows: DataFrame, chips=CHIPS) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, chips)), F.col("event_type"))
    return rows.orderBy(F.when(place > 0, place).otherwise(len(chips) + 1), "event_type")


def sorted_cells(rows: DataFrame, column: str, descending: bool = False, tie: str = "id") -> DataFrame:
    """Rows by a text column that may hold numbers: those first, as numbers, then the texts; nulls come last; equal ones by ``tie``."""
    cell = F.trim(column)
    number = F.regexp_replace(F.regexp_replace(cell, "[\u00a0 ]", ""), ",", ".").try_cast("double")
    keys = [number, F.lower(cell)]
    return rows.orderBy(F.col(column).isNull(), *(k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys), tie)


def activity_heatmap(events: DataFrame, metric: str = "count") -> DataFrame:
    """Monday is y = 0; x is the hour; cells without events don't appear."""
    value = {
        "total_duration_ms": ms(F.sum(own_us())), "peak_duration_ms": ms(F.max(own_us())), "error_count": count_of("EXCP", "TDEADLOCK").cast("double"),
    }.get(metric, F.count(F.lit(1)).cast("double"))
    return events.groupBy(F.weekday("ts").alias("y"), F.hour("ts").alias("x")).agg(value.alias("value"))


def preset(events: DataFrame, name: str, limit: int = 100) -> DataFrame:
    columns = ["id", "ts", "event_type", "duration_us", "session_id", "user_name", "context"]
    if name == "first_100":
        return events.select(*columns, "sql_text").orderBy("ts", "id").limit(limit)
    if name == "longest":
        return events.where(own_us().isNotNull()).select(*columns, "sql_text").orderBy(F.col("duration_us").desc_nulls_last(), "id").limit(limit)
    if name == "deadlocks":
        return of_types(events, ("TDEADLOCK",)).select(*columns).orderBy("ts", "id").limit(limit)
    raise ValueError(f"no preset {name}")


def plan_page(events: DataFrame, engine: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the statements that have an execution plan, the slowest first."""
    rows = with_plan(events)
    rows = rows.where(F.col("engine") == engine) if engine in ("mssql", "postgres") else rows
    columns = [F.col("id").alias("event_id"), "ts", "duration_us", F.substring("sql_text", 1, 200).alias("sql_preview"), F.length("plan_text").alias("plan_size"), "context", "engine"]
    return rows.select(*columns).orderBy(F.col("duration_us").desc_nulls_last(), F.col("ts").desc(), "event_id").offset(offset).limit(limit)


def with_plan(events: DataFrame) -> DataFrame:
    return events.where("plan_text is not null and plan_text <> ''")


def plan_counts(events: DataFrame) -> DataFrame:
    engine = F.coalesce(F.nullif("engine", F.lit("")), F.lit("unknown")).alias("engine")
    return with_plan(events).groupBy(engine).agg(F.count(F.lit(1)).alias("n"))


def engine_of() -> Column:
    """The stored engine, or else the one that the event's type tells."""
    told = F.when(F.col("event_type") == "DBMSSQL", "mssql").when(F.col("event_type") == "DBPOSTGRS", "postgres")
    return F.coalesce(F.nullif("engine", F.lit("")), told)


def event(events: DataFrame, id_: int) -> DataFrame:
    return events.where(F.col("id") == id_).limit(1)

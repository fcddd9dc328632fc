"""Filters that all views share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Events that repeat their parent's duration, and the event types with SQL.
CUMULATIVE = ("EXCPCNTX", "Context")
SQL_TYPES = ("DBMSSQL",)
CALL_TYPES = ("CALL", "SCALL")


def filtered(events: DataFrame, since=None, until=None, role: str | None = None, event_type: str | None = None) -> DataFrame:
    """Rows of a closed span of time, a process role and an event type; what is empty doesn't filter."""
    wanted = []
    stored = "ts_us" in events.columns  # an archive's times, by which files are skipped
    at, bound = (F.col("ts_us"), lambda x: micros(F.lit(x).cast("timestamp_ntz"))) if stored else (F.col("ts"), lambda x: F.lit(x).cast("timestamp_ntz"))
    if since:
        wanted.append(at >= bound(since))
    if until:
        wanted.append(at <= bound(until))
    if role:
        wanted.append(F.col("process_role") == role)
    if event_type:
        wanted.append(F.col("event_type") == event_type)
    return events.where(reduce(lambda a, b: a & b, wanted)) if wanted else events


def micros(ts: Column) -> Column:
    """Microseconds of a time without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def in_span(events: DataFrame, since=None, until=None) -> DataFrame:
    """Events from ``since`` on and before ``until`` (None: no bound). Of a stored archive only the row groups are read that hold such times."""
    at = F.col("ts_us") if "ts_us" in events.columns else micros(F.col("ts"))
    bound = lambda x: micros(F.lit(x).cast("timestamp_ntz"))
    events = events if since is None else events.where(at >= bound(since))
    return events if until is None else events.where(at < bound(until))


def of_types(events: DataFrame, types=()) -> DataFrame:
    return events.where(F.col("event_type").isin(*types)) if types else events


def by_context(events: DataFrame, presence: str | None = None) -> DataFrame:
    """``with`` or ``without`` a context other than spaces; anything else doesn't filter."""
    has = F.coalesce(F.trim("context") != "", F.lit(False))
    return events.where(has) if presence == "with" else events.where(~has) if presence == "without" else events


def containing(rows: DataFrame, needle: str) -> DataFrame:
    """Rows with the needle in any cell, whatever its case."""
    return rows.where(reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c).cast("string")).contains(needle.lower()), F.lit(False)) for c in rows.columns)))


def own_us() -> Column:
    """An event's own duration: null where it repeats its parent's, 0 where it has none."""
    return F.when(~F.col("event_type").isin(*CUMULATIVE), F.coalesce("duration_us", F.lit(0)))


def ms(us: Column) -> Column:
    return us / F.lit(1000.0)


def names(column: str) -> Column:
    """Distinct values in order, as one text; null if there are none."""
    return F.nullif(F.array_join(F.sort_array(F.collect_set(F.col(column).cast("string"))), ", "), F.lit(""))


def count_of(*types: str) -> Column:
    return F.count_if(F.col("event_type").isin(*types))

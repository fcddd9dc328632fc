"""Counts over usage records, profiles of the JSON column, rolling limits and merged ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import count_of


def tops(rows: DataFrame, columns: dict[str, int]) -> DataFrame:
    """kind, value, n: for each column its most frequent values, in one pass over the rows (grouping sets)."""
    cells = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = rows.select(F.explode(cells).alias("x")).where("x.value is not null").groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "value"))
    most = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), columns.items(), F.when(F.lit(False), 0))
    return counts.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def overall(rows: DataFrame, device: str) -> DataFrame:
    """total, devices: how many records there are, and of how many devices."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(device).alias("devices"))


def month_summary(rows: DataFrame, user: str, ts: str, device: str, success, billing) -> DataFrame:
    """By user and month the successful uses, the devices they came from, and how many of them were free and paid."""
    good = rows.where(success)
    return good.groupBy(F.col(user).alias("user"), F.date_trunc("month", F.col(ts)).cast("timestamp_ntz").alias("month")).agg(
        F.count(F.lit(1)).alias("used"), F.count_distinct(device).alias("devices"), F.count_if(billing == "free").alias("free"), F.count_if(billing == "paid").alias("paid")
    )


def cache_stats(entries: DataFrame, top: int = 10) -> DataFrame:
    """kind, n, bytes, hits, oldest, newest of cached entries (kind, key, size, hits, at), and the most used keys of each kind."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("hits").desc(), "key"))
    best = entries.withColumn("_n", place).where(F.col("_n") <= top)
    keys = best.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "key"))), lambda x: x["key"]), ",").alias("most_used"))
    sums = entries.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum("hits").alias("hits"), F.min("at").alias("oldest"), F.max("at").alias("newest"))
    return sums.join(keys, "kind")


def monthly_usage(rows: DataFrame, user: str, ts: str, kind: str) -> DataFrame:
    """Uses of each kind by user and month."""
    return rows.groupBy(F.col(user).alias("user"), F.date_trunc("month", F.col(ts)).cast("timestamp_ntz").alias("month"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("used"))


def remaining(usage: DataFrame, limit: int) -> DataFrame:
    return usage.withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)))


def json_profile(events: DataFrame, column: str = "extra", samples: int = 3) -> DataFrame:
    """event_type, key, kind (string, number, boolean, null, array or object), n and the first few distinct values."""
    value = F.try_parse_json(F.col(column)).alias("v")
    fields = events.select("event_type", F.from_json(column, "map<string,string>").alias("m"), value).select("event_type", F.explode("m").alias("key", "text"), "v")
    raw = F.schema_of_variant(F.try_variant_get("v", F.concat(F.lit("$['"), "key", F.lit("']")), "variant"))
    kind = F.when(raw.isNull() | (raw == "VOID"), "null").when(raw == "STRING", "string").when(raw == "BOOLEAN", "boolean").when(raw.startswith("ARRAY"), "array").when(raw.startswith("OBJECT"), "object").otherwise("number")
    each = fields.select("event_type", "key", kind.alias("kind"), "text").groupBy("event_type", "key", "kind", "text").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("event_type", "key", "kind").orderBy("text"))
    return each.withColumn("_n", place).groupBy("event_type", "key", "kind").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= samples, F.col("text")))), "|").alias("samples"))


def json_keys(events: DataFrame, column: str = "extra") -> DataFrame:
    """event_type, key, n, and how many of the values look like numbers: the keys of a JSON column."""
    pairs = events.select("event_type", F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    return pairs.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").try_cast("double").isNotNull()).alias("numbers"), F.min("value").alias("least"))


def composition(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("sql_text").alias("with_sql"), F.count("plan_text").alias("with_plan"), F.count("engine").alias("with_engine"))


def slowest_composition(events: DataFrame, limit: int = 200) -> DataFrame:
    """Event types among the slowest events."""
    slow = events.orderBy(F.col("duration_us").desc_nulls_last(), "id").limit(limit)
    return slow.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def hour_load(events: DataFrame, key: str = "session_id", seconds: int = 3600) -> DataFrame:
    """For each event how many its key had in the hour up to it, a rolling count; null without a key.

    A key's events are dealt out by the hour; each hour also gets the one before it, so no task holds all of a busy key."""
    at, span = F.unix_micros(F.col("ts").cast("timestamp")), seconds * 1_000_000
    rows = events.where(F.col(key).isNotNull()).select("id", F.col(key), at.alias("_at"))
    hour = F.floor(F.col("_at") / span)
    both = rows.select("*", F.explode(F.array(F.struct(hour.alias("hour"), F.lit(True).alias("own")), F.struct((hour + 1).alias("hour"), F.lit(False).alias("own")))).alias("_h"))
    w = Window.partitionBy(key, "_h.hour").orderBy("_at").rangeBetween(-span, 0)
    counted = both.withColumn("in_the_hour", F.count(F.lit(1)).over(w)).where("_h.own").select("id", key, "in_the_hour")
    return counted.unionByName(events.where(F.col(key).isNull()).select("id", key, F.lit(None).cast("long").alias("in_the_hour")))


def last_before(left: DataFrame, right: DataFrame, by: str, at: str, value: str, bucket: str = "day") -> DataFrame:
    """Each row of ``left`` with ``value`` of the latest row of ``right`` of the same key at or before its time, or null.

    Both are dealt out by key and day; what a day begins with is told by one row per key and day, so no task holds all of a busy key."""
    day = F.date_trunc(bucket, F.col(at))
    names = left.columns
    rows = left.select(F.lit(1).alias("_side"), by, at, F.struct(*names).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    known = right.select(F.lit(0).alias("_side"), by, at, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    both = rows.unionByName(known).withColumn("_day", day)
    last = lambda w: F.last("_value", ignorenulls=True).over(w)
    within = both.withColumn("_own", last(Window.partitionBy(by, "_day").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))).where("_side = 1")
    ends = known.withColumn("_day", day).groupBy(by, "_day").agg(F.max_by("_value", at).alias("_value"))
    days = within.select(by, "_day").distinct().withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).unionByName(ends).groupBy(by, "_day").agg(F.max("_value").alias("_value"))
    carried = days.select(by, "_day", last(Window.partitionBy(by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    joined = within.join(carried, [by, "_day"])
    return joined.select("_row.*", F.coalesce("_own", "_carried").alias(f"last_{value}"))


def grouped_ranges(ranges: DataFrame, by: list[str], start: str, end: str, width: int) -> DataFrame:
    """The half-open ranges with _group: a number that those of a key share which overlap, directly or by others.

    A key's ranges are dealt out by ``width`` of their starts. What a part begins with, the latest end and the number of groups
    before it, is told by one row per part, so no task holds all of a busy key."""
    part = [*by, "_part"]
    rows = ranges.withColumn("_part", F.floor(F.col(start) / width))
    within = Window.partitionBy(*part).orderBy(start, end)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in part))
    ends = rows.groupBy(*part).agg(F.max(end).alias("_end")).withColumn("_carried", F.max("_end").over(earlier)).drop("_end")
    carried = rows.join(ends, same(rows, ends)).select(rows["*"], "_carried")
    before = F.greatest("_carried", F.max(end).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    marked = carried.withColumn("_new", F.when(before > F.col(start), 0).otherwise(1))
    numbered = marked.withColumn("_local", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    counts = marked.groupBy(*part).agg(F.sum("_new").alias("_count")).withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0))).drop("_count")
    return numbered.join(counts, same(numbered, counts)).select(*(numbered[c] for c in ranges.columns), (F.col("_before") + F.col("_local")).alias("_group"))


#: A day of microseconds.
DAY = 86_400_000_000


def islands(ranges: DataFrame, by: list[str], start: str, end: str, width: int = DAY) -> DataFrame:
    """Half-open ranges that overlap, merged: one row per group with its bounds and number of ranges."""
    grouped = grouped_ranges(ranges, by, start, end, width)
    return grouped.groupBy(*by, "_group").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).drop("_group")


def range_groups(findings: DataFrame, by: list[str], start: str, end: str, severities: tuple[str, ...], width: int = DAY) -> DataFrame:
    """Findings whose half-open ranges overlap, as one: its bounds, the worst severity, and the codes, worst first."""
    rank = F.array_position(F.array(*map(F.lit, severities)), F.col("severity"))
    grouped = grouped_ranges(findings, by, start, end, width).withColumn("_rank", rank)
    codes = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_rank", "code"))), lambda x: x["code"]), ",")
    return grouped.groupBy(*by, "_group").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.min_by("severity", "_rank").alias("severity"), codes.alias("codes")).drop("_group")


def shares(events: DataFrame) -> DataFrame:
    """operation, sql_share of the duration, lock_share of the events; 0 where there is nothing to divide by."""
    sql = F.sum(F.when(F.col("event_type") == "DBMSSQL", F.coalesce("duration_us", F.lit(0))).otherwise(0))
    total, n = F.sum(F.coalesce("duration_us", F.lit(0))), F.count(F.lit(1))
    rows = events.where("context_normalized is not null").groupBy(F.col("context_normalized").alias("operation"))
    return rows.agg(F.coalesce(F.try_divide(sql, total), F.lit(0.0)).alias("sql_share"), (count_of("TLOCK", "TDEADLOCK") / n).alias("lock_share"))

"""The lock fields of an event's ``extra`` JSON, as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(extra: Column, *names: str) -> Column:
    """The first of the named fields that has a text."""
    return F.coalesce(*(F.nullif(F.get_json_object(extra, f"$.{n}"), F.lit("")) for n in names))


def problem(extra: Column) -> Column:
    """The first 200 characters of what isn't a JSON object; null where it is one, or there is none."""
    kind = F.schema_of_variant(F.try_parse_json(extra))
    return F.when(extra.isNotNull() & ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.substring(extra, 1, 200))


def _parts(c: Column, pattern: str) -> Column:
    found = F.filter(F.transform(F.split(c, pattern), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def regions(extra: Column) -> Column:
    """array<struct<raw, object_name, mode>>; the last word of each part is the lock's mode."""

    def one(x):
        mode = F.nullif(F.regexp_extract(x, r"(?s)^(.*?)\s+(\S+)$", 2), F.lit(""))
        return F.struct(x.alias("raw"), F.when(mode.isNull(), x).otherwise(F.regexp_extract(x, r"(?s)^(.*?)\s+(\S+)$", 1)).alias("object_name"), mode.alias("mode"))

    return F.transform(_parts(field(extra, "Regions", "Locks"), r"[,;\n]"), one)


def waits(extra: Column) -> Column:
    return _parts(field(extra, "WaitConnections"), ",")


def edges(extra: Column) -> Column:
    """array<struct<waiter, blocker, resource>>; the blocker is the waiter of the next pair, around the cycle."""
    raw = field(extra, "DeadlockConnectionIntersections", "DeadlockIntersections")
    who = F.coalesce(F.regexp_extract_all(raw, F.lit(r"(\S+)->([^|]+)"), F.lit(1)), F.array().cast("array<string>"))
    what = F.regexp_extract_all(raw, F.lit(r"(\S+)->([^|]+)"), F.lit(2))
    after = F.concat(F.slice(who, 2, F.size(who)), F.slice(who, 1, 1))
    pair = lambda w, i: F.struct(w.alias("waiter"), F.get(after, i).alias("blocker"), F.trim(F.get(what, i)).alias("resource"))
    return F.transform(who, pair)


def participants(session: Column, waiting: Column, edge: Column) -> Column:
    """All connections that take part, as texts in order."""
    ends = F.concat(F.transform(edge, lambda e: e["waiter"]), F.transform(edge, lambda e: e["blocker"]))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(session.cast("string")), waiting, ends), lambda x: x.isNotNull())))

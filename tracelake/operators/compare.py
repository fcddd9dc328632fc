"""Two archives side by side, and regressions of operations between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import context_signature
from .filters import SQL_TYPES, count_of, ms
from .views import statement_figures, statements

# Percentages from which a statement counts as slower or faster, and the counts that give confidence.
SLOWER, FASTER = 50.0, -30.0
HIGH, MEDIUM = 20, 5


def archive(events: DataFrame, name: str) -> DataFrame:
    return events.where(F.col("archive_id") == name)


def summary(events: DataFrame, a: str, b: str) -> DataFrame:
    """metric, a, b, delta, delta_percent (null where a is 0): one pass over both archives."""
    both = events.where(F.col("archive_id").isin(a, b)).groupBy("archive_id").agg(
        F.count(F.lit(1)).cast("double").alias("events_count"), ms(F.coalesce(F.sum("duration_us"), F.lit(0))).alias("total_duration_ms"), F.coalesce(ms(F.avg("duration_us")), F.lit(0.0)).alias("avg_duration_ms"),
        count_of("EXCP").cast("double").alias("exceptions"), count_of("TDEADLOCK").cast("double").alias("deadlocks"), count_of("TLOCK").cast("double").alias("locks"),
    )
    metrics = [c for c in both.columns if c != "archive_id"]
    long = both.unpivot(["archive_id"], metrics, "metric", "value")
    side = lambda x: F.coalesce(F.max(F.when(F.col("archive_id") == x, F.col("value"))), F.lit(0.0))
    wide = long.groupBy("metric").agg(side(a).alias("a"), side(b).alias("b"))
    change = F.col("b") - F.col("a")
    return wide.select("metric", "a", "b", change.alias("delta"), F.when(F.col("a") != 0, F.round(change * 100 / F.col("a"), 2)).alias("delta_percent"))


def _costliest(events: DataFrame, a: str, b: str, limit: int, types) -> DataFrame:
    """sql_text_hash, and as ``a`` and ``b`` the statement's figures where it is among an archive's costliest: one pass over both archives."""
    grouped = statement_figures(statements(events.where(F.col("archive_id").isin(a, b)), types).groupBy("archive_id", "sql_text_hash"))
    place = F.row_number().over(Window.partitionBy("archive_id").orderBy(F.col("total_duration_ms").desc_nulls_last(), "sql_text_hash"))
    top = grouped.withColumn("_n", place).where(F.col("_n") <= limit)
    figures = F.struct("query", "calls", F.col("total_duration_ms").alias("total_ms"), F.col("avg_duration_ms").alias("avg_ms"))
    side = lambda x: F.max(F.when(F.col("archive_id") == x, figures))
    return top.groupBy("sql_text_hash").agg(side(a).alias("a"), side(b).alias("b"))


def common_statements(events: DataFrame, a: str, b: str, limit: int = 50, types=SQL_TYPES) -> DataFrame:
    """Statements among the costliest of both archives, and the change of their mean duration."""
    both = _costliest(events, a, b, limit, types).where("a is not null and b is not null")
    change = F.when(F.col("a.avg_ms") > 0, F.round((F.col("b.avg_ms") - F.col("a.avg_ms")) * 100 / F.col("a.avg_ms"), 2)).otherwise(0.0)
    return both.select(
        "sql_text_hash", F.col("b.query").alias("query"), F.col("a.avg_ms").alias("a_avg_ms"), F.col("b.avg_ms").alias("b_avg_ms"), F.col("a.calls").alias("a_calls"), F.col("b.calls").alias("b_calls"), change.alias("delta_percent")
    )


def slower(common: DataFrame) -> DataFrame:
    return common.where(F.col("delta_percent") >= SLOWER)


def faster(common: DataFrame) -> DataFrame:
    return common.where(F.col("delta_percent") <= FASTER)


def only_in(events: DataFrame, a: str, b: str, limit: int = 50, types=SQL_TYPES) -> DataFrame:
    """Statements among the costliest of ``a`` and not among those of ``b``."""
    return _costliest(events, a, b, limit, types).where("a is not null and b is null").select("sql_text_hash", "a.*")


def exact_quantiles(counts: DataFrame, by: str, value: str, n: str, shares: dict[str, float], *more: Column) -> DataFrame:
    """``by``, a column per share, and ``more`` aggregates: the value at that share of a group's rows, between two values in proportion.

    ``counts`` has how often each value occurs in a group. They are summed up in order, so a group's values are sorted on disk if need be and
    never held in memory."""
    group = Window.partitionBy(by)
    summed = counts.withColumns({"_upto": F.sum(n).over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(n).over(group)})
    at = {name: (F.col("_all") - 1) * F.lit(share) for name, share in shares.items()}
    ends = [F.min(F.when(F.col("_upto") > place(x), F.col(value))).alias(f"_{name}_{end}") for name, x in at.items() for end, place in (("low", F.floor), ("high", F.ceil))]
    found = summed.groupBy(by).agg(F.max("_all").alias("_all"), *ends, *more)
    between = lambda name: F.col(f"_{name}_low") + (at[name] - F.floor(at[name])) * (F.col(f"_{name}_high") - F.col(f"_{name}_low"))
    return found.withColumns({name: between(name) for name in shares}).drop("_all", *(f"_{name}_{end}" for name in shares for end in ("low", "high")))


def load_operations(events: DataFrame) -> DataFrame:
    """operation, the context of its slowest run, its runs, p50 and p95 in milliseconds: one pass over the events."""
    rows = events.where("context_normalized <> '' and duration_us > 0").withColumnRenamed("context_normalized", "operation")
    first = F.min_by("context", F.when(F.col("context").isNotNull(), F.col("id"))).alias("_context")
    counts = rows.groupBy("operation", "duration_us").agg(F.count(F.lit(1)).alias("_n"), first)
    slowest = F.max_by("_context", F.when(F.col("_context").isNotNull(), F.col("duration_us"))).alias("context")
    found = exact_quantiles(counts, "operation", "duration_us", "_n", {"p50": 0.5, "p95": 0.95}, slowest, F.sum("_n").alias("samples"))
    return found.select("operation", "context", "samples", *(F.round(F.col(q) / 1000.0, 3).alias(q) for q in ("p50", "p95")))


def with_signature(operations: DataFrame) -> DataFrame:
    return operations.withColumn("signature", F.concat_ws("|", F.trim("operation"), context_signature(F.col("context"))))


def _confidence(n: Column) -> Column:
    return F.when(n >= HIGH, "high").when(n >= MEDIUM, "medium").otherwise("low")


def regressions(baseline: DataFrame, current: DataFrame, threshold: float = 2.0, min_samples: int = 5, top_n: int | None = None) -> DataFrame:
    """Operations of two archives matched by signature and classified by the ratio of their p95.

    Of several with one signature the last by operation and context counts. ``min_samples`` asks for as many runs on one side
    at least; ``top_n`` keeps the first of each class, by priority, improvements by ratio.
    """
    if threshold < 1:
        raise ValueError("threshold must be at least 1")

    def side(rows: DataFrame, prefix: str) -> DataFrame:
        last = rows.groupBy("signature").agg(F.max(F.struct("operation", "context", "samples", "p50", "p95")).alias("r"))
        return last.select("signature", *(F.col(f"r.{c}").alias(f"{prefix}_{c}") for c in ("operation", "samples", "p50", "p95")))

    rows = side(with_signature(baseline), "base").join(side(with_signature(current), "cur"), "signature", "full_outer")
    base, cur, n, before = F.col("base_p95"), F.col("cur_p95"), F.col("cur_samples"), F.col("base_samples")
    ratio = F.when(base > 0, cur / base).when(cur > 0, None).otherwise(1.0)
    kind = (
        F.when(before.isNull(), "new").when(n.isNull(), "disappeared").when((base <= 0) & (cur > 0), "regression")
        .when(ratio >= threshold, "regression").when(ratio <= 1.0 / threshold, "improvement").otherwise("stable")
    )
    weight = lambda c: F.log1p(c.cast("double"))
    matched = before.isNotNull() & n.isNotNull()
    out = rows.withColumns({"change_type": kind, "p95_ratio": F.when(matched, ratio), "count_ratio": F.when(matched & (before > 0), n / before)})
    priority = (
        F.when(F.col("change_type") == "new", cur * weight(n)).when(F.col("change_type") == "disappeared", base * weight(before) * 0.1)
        .when((F.col("change_type") == "regression") & F.col("p95_ratio").isNotNull(), (F.col("p95_ratio") - 1.0) * weight(n) * cur)
        .when(F.col("change_type") == "regression", cur * weight(n) * 10).otherwise(0.0)
    )
    least = F.least(before, n)  # of one side only where the other is missing
    out = out.withColumns({"priority_score": priority, "confidence": _confidence(least), "operation": F.coalesce("cur_operation", "base_operation")}).drop("cur_operation", "base_operation")
    if min_samples > 0:
        out = out.where((F.coalesce(before, F.lit(0)) >= min_samples) | (F.coalesce(n, F.lit(0)) >= min_samples))
    if top_n is not None:
        rank = F.when(F.col("change_type") == "improvement", F.coalesce("p95_ratio", F.lit(1.0))).otherwise(-F.col("priority_score"))
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("change_type").orderBy(rank, "signature"))).where(F.col("_n") <= top_n).drop("_n")
    return out


def matched_count(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """total_operations_matched: signatures that both archives have, before any filter."""
    a, b = (with_signature(x).select("signature").distinct() for x in (baseline, current))
    return a.join(b, "signature").agg(F.count(F.lit(1)).alias("total_operations_matched"))


def change_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def delta_tone(percent: Column, metric: Column) -> Column:
    """err, warn, ok or neutral, by how much a metric has grown."""
    return F.when(percent.isNull() | (metric == "events_count"), "neutral").when(percent >= 50, "err").when(percent >= 20, "warn").when(percent <= -30, "ok").otherwise("neutral")

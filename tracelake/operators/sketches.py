"""Small summaries of archives that merge: per hour and operation, so that reports over any span are made without reading events again.

Durations are held as KLL sketches and sessions as HyperLogLog sketches, made by Spark's own aggregates. Counts and sums are exact. With
K = 400 the rank of an estimated quantile is off by less than RANK_ERROR with a probability of 0.99; with 2**LG_K buckets an estimated number
of distinct sessions has a relative standard error of DISTINCT_ERROR. Both hold after any merging.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, LG_K = 400, 12
RANK_ERROR, DISTINCT_ERROR = 0.0083, 1.04 / 2 ** (LG_K / 2)
SHARES = {"p50": 0.5, "p95": 0.95}


def hourly(events: DataFrame) -> DataFrame:
    """archive_id, hour, operation, samples, total_us, slowest_us, durations, sessions: one row per archive, hour and operation, to be stored
    as a table. Events without an operation or a duration above zero are left out, as in the exact report."""
    rows = events.where("context_normalized <> '' AND duration_us > 0")
    return rows.groupBy("archive_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("context_normalized").alias("operation")).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("duration_us").alias("total_us"), F.max("duration_us").alias("slowest_us"),
        F.kll_sketch_agg_bigint("duration_us", F.lit(K)).alias("durations"), F.hll_sketch_agg(F.col("session_id").cast("long"), F.lit(LG_K)).alias("sessions"),
    )


def merged(sketched: DataFrame, *by: str) -> DataFrame:
    """The summaries of larger groups: by operation over all hours, by hour over all operations, and so on. Merging again gives the same kind."""
    return sketched.groupBy(*by).agg(
        F.sum("samples").alias("samples"), F.sum("total_us").alias("total_us"), F.max("slowest_us").alias("slowest_us"), F.kll_merge_agg_bigint("durations", F.lit(K)).alias("durations"), F.hll_union_agg("sessions").alias("sessions")
    )


def figures(summaries: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """samples, total and slowest in milliseconds (exact), the quantiles in milliseconds and the number of sessions (estimated)."""
    keys = [c for c in summaries.columns if c not in ("samples", "total_us", "slowest_us", "durations", "sessions")]
    quantiles = [(F.kll_sketch_get_quantile_bigint("durations", F.lit(q)) / 1000.0).alias(name) for name, q in shares.items()]
    return summaries.select(*keys, "samples", (F.col("total_us") / 1000.0).alias("total_ms"), (F.col("slowest_us") / 1000.0).alias("slowest_ms"), *quantiles, F.hll_sketch_estimate("sessions").alias("sessions"))


def compared(sketched: DataFrame, baseline: str, current: str) -> DataFrame:
    """operation, and of both archives the samples, p50 and p95, with the ratio of the p95: from the stored summaries alone. Null where an
    archive hasn't the operation."""
    found = figures(merged(sketched.where(F.col("archive_id").isin(baseline, current)), "archive_id", "operation"))
    side = lambda name, prefix: found.where(F.col("archive_id") == name).select("operation", *(F.col(c).alias(f"{prefix}_{c}") for c in ("samples", "p50", "p95")))
    rows = side(baseline, "base").join(side(current, "cur"), "operation", "full_outer")
    return rows.withColumn("ratio", F.try_divide("cur_p95", "base_p95"))


def outside(summaries: DataFrame, events: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """operation, samples, and for each quantile how far its rank among the events' durations is from the share asked for: 0 within a run of equal
    durations. A check of stored summaries by operation against the events themselves."""
    asked = figures(summaries, shares).select("operation", *(F.round(F.col(q) * 1000).cast("long").alias(q) for q in shares))
    rows = events.where("context_normalized <> '' AND duration_us > 0").select(F.col("context_normalized").alias("operation"), "duration_us").join(asked, "operation")
    ranks = [F.avg((F.col("duration_us") < F.col(q)).cast("double")).alias(f"_{q}_below") for q in shares] + [F.avg((F.col("duration_us") <= F.col(q)).cast("double")).alias(f"_{q}_upto") for q in shares]
    off = [F.greatest(F.lit(0.0), F.col(f"_{q}_below") - share, share - F.col(f"_{q}_upto")).alias(f"{q}_off") for q, share in shares.items()]
    return rows.groupBy("operation").agg(F.count(F.lit(1)).alias("samples"), *ranks).select("operation", "samples", *off)

"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

SEED = 20240229
#: A table of more sources than this is joined by salted keys, not broadcast.
FEW_SOURCES = 100_000
SALTS = 64


def _uniform(*parts):
    """A number in [0, 1) from the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), *parts)), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None) -> DataFrame:
    """_source, rate, cdf: each source's mean repetition rate, weight * total / its documents, and P(count <= k) for k = 0, 1, ...

    ``weights`` default to equal ones; sources without a weight get none; None names the null source. ``total`` is the number of
    documents aimed at, by default that of ``docs``. The table of probabilities goes on until far beyond any 52-bit number.
    """
    counts = docs.groupBy(F.col("source").cast("string").alias("_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k if k is None else str(k), float(v)) for k, v in weights.items()], "_given string, w double")
        weighted = counts.join(given, F.col("_source").eqNullSafe(F.col("_given")), "left").drop("_given").fillna(0.0, ["w"])
    sums = weighted.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    aim = F.lit(float(total)) if total is not None else F.col("all_n").cast("double")
    rated = weighted.crossJoin(F.broadcast(sums)).select("_source", F.coalesce(F.try_divide(F.col("w"), F.col("all_w")) * aim / F.col("n"), F.lit(0.0)).alias("rate"))
    log_rate = F.ln(F.greatest("rate", F.lit(1e-300)))
    # The k-th probability follows from the one before it, in logarithms: rates of hundreds don't underflow.
    steps = F.sequence(F.lit(1), (F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int"))
    first = F.struct((-F.col("rate")).alias("log_p"), F.exp(-F.col("rate")).alias("sum"), F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def add(acc, k):
        log_p = acc["log_p"] + log_rate - F.ln(k.cast("double"))
        total_ = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total_.alias("sum"), F.concat(acc["cdf"], F.array(total_)).alias("cdf"))

    return rated.select("_source", "rate", F.aggregate(steps, first, add, lambda acc: acc["cdf"]).alias("cdf"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, key: str = "doc_id", copy: str | None = "_copy") -> DataFrame:
    """All columns of ``docs`` and the number of the copy (1, 2, ...), each row as often as its Poisson count says, in random order.

    The count inverts the Poisson distribution of the row's source at a number hashed from its ``key``; so it is
    0, 1 or more, the same in every run, and equal for repeated rows. A null source is a source by itself, and a null key
    hashes as an empty one. Texts aren't looked at. The order is that of a hash of key and copy: rows are dealt over
    partitions by it and sorted within each. ``copy`` names the added column, which ``docs`` must not have (ValueError); with None
    there is none. Columns named like those used here stay as they are. No rows give no rows.
    """
    names = docs.columns
    if copy in names:
        raise ValueError(f"there is a column {copy} already")
    table = rates(docs, weights, total)
    rows = docs.select(F.struct(*names).alias("_row"), F.col("source").cast("string").alias("_of"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"))
    same = F.col("_of").eqNullSafe(F.col("_source"))
    if table.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        rows = rows.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_part") == F.col("_salt")))
    count = F.size(F.filter("cdf", lambda c: c <= _uniform(F.col("_key"))))
    copies = rows.withColumn("_n", count).where("_n > 0").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    order = F.xxhash64(F.lit(SEED), "_key", "_nth")
    dealt = copies.withColumn("_order", order).repartition("_order").sortWithinPartitions("_order")
    return dealt.select("_row.*", *([F.col("_nth").alias(copy)] if copy else []))


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("_copy").alias("copy"), F.octet_length("text").alias("n_bytes"), F.md5(F.encode("text", "utf-8")).alias("text_md5"))


QUERIES = {"op7_poisson_mixing": op7_poisson_mixing}
ORACLES = {
    "op7_poisson_mixing": f"""
WITH n AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT s, (1.0::DOUBLE / (SELECT count(*) FROM n)) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n),
p AS (SELECT s, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS below
      FROM r, (SELECT unnest(range(0, 400)) AS k) WHERE k <= rate + 12 * sqrt(rate) + 24),
d AS (SELECT *, source AS s,
      ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
c AS (SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM p WHERE p.s IS NOT DISTINCT FROM d.s AND p.below <= d.u) AS m FROM d)
SELECT doc_id, source, unnest(range(1, m + 1))::INT AS copy, strlen(text)::INT AS n_bytes, md5(text) AS text_md5 FROM c WHERE m > 0
"""
}

"""The relational surface of the console: one statement each, the same in both engines unless said."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.console import console

D = "::DOUBLE"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SAME = {
    "j_inner": "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "j_left": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "j_right": "SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON s_nationkey = n_nationkey AND n_regionkey = 1",
    "j_full": "SELECT c.n AS customers, s.n AS suppliers, coalesce(c.k, s.k) AS nation FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.k = s.k",
    "j_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "j_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "j_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "j_many": "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 1) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY r_name",
    "j_range": "WITH b AS (SELECT * FROM (VALUES (0, 0.0, 1000.0), (1, 1000.0, 5000.0), (2, 5000.0, 100000.0)) AS t(band, lo, hi)) SELECT band, count(*) AS n FROM supplier JOIN b ON s_acctbal >= lo AND s_acctbal < hi GROUP BY band",
    "g_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "g_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "g_grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "g_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "g_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "g_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "g_pricing": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 1) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "w_row_number": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders) t WHERE place <= 3",
    "w_ranks": "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d, percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS p FROM part",
    "w_lag_lead": "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "w_running_count": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent FROM events",
    "w_first_last": "SELECT DISTINCT user_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type FROM events",
    "u_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "u_union_all": "SELECT 'c' AS kind, count(*) AS n FROM customer UNION ALL SELECT 's', count(*) FROM supplier",
    "u_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier",
    "u_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000",
    "u_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "w_ntile": "SELECT p_partkey, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS quarter, nth_value(p_partkey, 3) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM part",
    "j_lateral": "SELECT n_name, t.c_custkey, t.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t",
    "u_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "s_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n FROM big JOIN customer ON o_custkey = c_custkey WHERE total > 1000000 GROUP BY c_mktsegment",
    "s_scalar_subquery": "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "s_correlated": "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "s_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "s_case_like": "SELECT CASE WHEN p_name LIKE '%green%' THEN 'green' ELSE 'other' END AS colour, count(*) AS n FROM part GROUP BY 1",
}


def _tables(spark, sf_dir: str) -> dict:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def _ask(sql: str):
    return lambda spark, sf_dir: console(spark, sql, _tables(spark, sf_dir))


def as_of(spark, sf_dir: str):
    """Each purchase with the latest click of its user at or before it."""
    from ..operators.usage import last_before

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", F.col("ts").alias("click_ts"))
    side = lambda kind, *columns: e.where(F.col("event_type") == kind).select(*columns)
    joined = last_before(side("purchase", "event_id", "user_id", "ts"), side("click", "user_id", "ts", "click_ts"), "user_id", "ts", "click_ts")
    return joined.select("event_id", "user_id", F.col("last_click_ts").alias("click_ts"))


def pivot(spark, sf_dir: str):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    wide = o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderpriority", *(F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")))


def fuzzy(spark, sf_dir: str):
    from ..operators.dictionary import suggestions

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    wrong = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.concat(F.lit("x"), "p_name").alias("name"))
    return suggestions(wrong, p.select(F.col("p_brand").alias("kind"), F.col("p_name").alias("name")).distinct())


QUERIES = {k: _ask(sql) for k, sql in SAME.items()} | {"j_as_of": as_of, "g_pivot": pivot, "j7_fuzzy": fuzzy}
ORACLES = dict(SAME) | {
    "j_as_of": "SELECT p.event_id, p.user_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts",
    "g_pivot": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1",
    "j7_fuzzy": "WITH w AS (SELECT p_partkey AS id, p_brand AS kind, 'x' || p_name AS name FROM part WHERE p_partkey % 50 = 0), k AS (SELECT DISTINCT p_brand AS kind, p_name AS known FROM part),"
    " m AS (SELECT id, w.kind, name, known, levenshtein(lower(name), lower(known))::INT AS distance FROM w JOIN k ON w.kind = k.kind WHERE levenshtein(lower(name), lower(known)) <= 3 AND lower(name) <> lower(known))"
    " SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id, kind, name ORDER BY distance, known) <= 5",
}

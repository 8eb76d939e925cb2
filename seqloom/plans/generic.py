"""Relational coverage over the star schema and the plain event table, declared and left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators.ordered import numbered
from seqloom.operators.sequence import last_before
from seqloom.session import broadcast_if_small
from seqloom.sources.tables import table



def join_inner_star(spark: SparkSession, d: str) -> DataFrame:
    """Items and quantity by nation of the customer."""
    li, o = table(spark, d, "lineitem", "l_orderkey", "l_quantity"), table(spark, d, "orders", "o_orderkey", "o_custkey")
    per_order = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))  # before the join
    c = table(spark, d, "customer", "c_custkey", "c_nationkey").join(broadcast_if_small(table(spark, d, "nation", "n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    j = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("n_name").agg(F.sum("n").alias("n_items"), F.sum("q").cast("bigint").alias("quantity"))


def join_left_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order."""
    return table(spark, d, "customer", "c_custkey", "c_name").join(table(spark, d, "orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def join_semi(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of some large item."""
    big = table(spark, d, "lineitem", "l_suppkey", "l_quantity").where("l_quantity >= 49")
    return table(spark, d, "supplier", "s_suppkey", "s_name").join(big, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")


def asof_last_event(spark: SparkSession, d: str) -> DataFrame:
    """Each error with the latest click of its user before it: an as-of join by one look back, in blocks."""
    ev = table(spark, d, "events", "event_id", "ts", "user_id", "event_type").where(F.col("event_type").isin("error", "click"))
    ev = ev.select(F.col("user_id").alias("capture_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id", "event_type")
    back = last_before(numbered(ev, "capture_id", "ts_us", "event_id"), F.when(F.col("event_type") == "click", F.col("event_id")), "click_id")
    return back.where("event_type = 'error'").select("event_id", F.coalesce("click_id", F.lit(-1)).alias("click_id"))


def cube_segment_status(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders", "o_custkey", "o_orderstatus").join(table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.cube("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


def rollup_nation_region(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(broadcast_if_small(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey").join(broadcast_if_small(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


def setop_intersect_except(spark: SparkSession, d: str) -> DataFrame:
    """Nations with customers, by whether they have suppliers too."""
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customers")))


def rank_top_customers(spark: SparkSession, d: str) -> DataFrame:
    """The three best balances of each segment, ties by key."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    return c.select("c_mktsegment", "c_custkey", F.row_number().over(w).cast("bigint").alias("rank")).where("rank <= 3")


def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events", "event_type", "props").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return ev.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"))


def window_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranking functions over the orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return o.select("o_orderkey", F.rank().over(w).cast("bigint").alias("rank"), F.ntile(4).over(w).cast("bigint").alias("quarter"), F.coalesce(F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).cast("bigint"), F.lit(-1)).alias("gap_days"))


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the plain event table's users at a gap of six hours."""
    from seqloom.operators.sessions import sessions

    ev = table(spark, d, "events", "user_id", "ts").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    return sessions(ev, "user_id", "ts_us", 21_600_000_000)


def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per type in windows of six hours every two."""
    ev = table(spark, d, "events", "ts", "event_type")
    g = ev.groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours", "2 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")


QUERIES = {f.__name__: f for f in (join_inner_star, join_left_anti, join_semi, asof_last_event, cube_segment_status, rollup_nation_region, setop_intersect_except, rank_top_customers, json_props_extract, window_ranks, user_sessions, sliding_counts)}
ORACLE = {
    "join_inner_star": "SELECT n_name, count(*) AS n_items, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_left_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_semi": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49)",
    "asof_last_event": "WITH x AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM events WHERE event_type IN ('error', 'click')) SELECT event_id, coalesce(c, -1) AS click_id FROM x WHERE event_type = 'error'",
    "cube_segment_status": "SELECT c_mktsegment, o_orderstatus, count(*) AS n, grouping(c_mktsegment, o_orderstatus)::BIGINT AS level FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderstatus)",
    "rollup_nation_region": "SELECT r_name, n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "setop_intersect_except": "SELECT k, 'both' AS side FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'customers' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)",
    "rank_top_customers": "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 3",
    "json_props_extract": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, min(k) AS least, max(k) AS most FROM (SELECT event_type, (props->>'$.k')::BIGINT AS k FROM events) GROUP BY event_type",
    "window_ranks": "SELECT o_orderkey, rank() OVER w AS rank, ntile(4) OVER w AS quarter, coalesce(datediff('day', lag(o_orderdate) OVER w, o_orderdate), -1) AS gap_days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "user_sessions": "WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_events FROM s GROUP BY user_id, sid",
    "sliding_counts": "WITH x AS (SELECT event_type, epoch_us(ts) AS t, unnest(range(3)) AS i FROM events) SELECT t // 7200000000 * 7200000000 - i * 7200000000 AS start_us, event_type, count(*) AS n FROM x GROUP BY ALL",
}

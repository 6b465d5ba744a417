"""Star-schema joins, event windows, and the incremental build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import scratch
from quern.plans.registry import query
from quern.sources.tables import table
from quern.streaming import incremental


@query("SELECT c_mktsegment, count(*)::bigint AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) GROUP BY 1")
def q_semi_star(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a large order, by segment."""
    large = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(large, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey::bigint AS c_nationkey, count(*)::bigint AS n FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) GROUP BY 1")
def q_anti_star(spark: SparkSession, d: str) -> DataFrame:
    """Customers without orders, by nation."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_anti").groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(DISTINCT l_partkey)::bigint AS parts, count(DISTINCT l_orderkey)::bigint AS orders FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name")
def q_distinct_star(spark: SparkSession, d: str) -> DataFrame:
    """Distinct parts and orders of each supplier nation."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    return li.join(s, "l_suppkey").groupBy("n_name").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::bigint AS at, count(*)::bigint AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def q_window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events of each hour."""
    return _events(spark, d).groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("window.start").alias("at"), "n", "total")


@query("""SELECT epoch(b)::bigint AS at, count(*)::bigint AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(h) AS b FROM events, unnest([0, 1]) AS t(h)) GROUP BY b""")
def q_window_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events of every two hours, hour by hour."""
    return _events(spark, d).groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("window.start").alias("at"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM g)
SELECT user_id, epoch_us(min(ts)) // 1000000 AS at, count(*)::bigint AS n FROM s GROUP BY user_id, g""")
def q_window_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user that ten quiet hours end."""
    s = _events(spark, d).groupBy("user_id", F.session_window("ts", "10 hours")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_timestamp("session_window.start").alias("at"), "n")


@query("SELECT doc_id, sha256('v1' || chr(10) || text) AS chunk_key, length(text)::bigint AS size FROM documents")
def q_incremental_build(spark: SparkSession, d: str) -> DataFrame:
    """An index built from a stream of the documents in micro-batches, then run again without new work."""
    index = f"{scratch.scratch_dir(spark)}/{incremental.fresh_name('index')}"
    for _ in range(2):
        incremental.build(spark, f"{d}/documents.parquet", index, "v1")
    return incremental.read_index(spark, index)


@query("SELECT user_id, arg_max(event_type, row(ts, event_id)) AS state, count(*)::bigint AS n FROM events GROUP BY user_id")
def q_stream_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each user, kept by a stream over the events."""
    return incremental.latest_states(spark, f"{d}/events.parquet")

"""Relational shapes over the star schema, and a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskiln.operators import store as st
from corpuskiln.streaming import jobs
from corpuskiln.session import shared_folder
from corpuskiln.tables import table


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate").filter("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(paid), 2).alias("sum_paid"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n"))


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    """The ten orders with the most revenue of a market segment."""
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment").filter("c_mktsegment = 'BUILDING'")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    li = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    g = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return g.orderBy(F.desc("revenue"), "l_orderkey").limit(10)


def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of suppliers by nation and region."""
    li = table(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_discount").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count(F.lit(1)).alias("suppliers"))


def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    """Per segment: customers, those without any order, and those without an urgent one."""
    c, o = table(spark, d, "customer", "c_custkey", "c_mktsegment"), table(spark, d, "orders", "o_custkey", "o_orderpriority")
    none = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_mktsegment", F.lit("none").alias("what"))
    calm = c.join(o.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_mktsegment", F.lit("calm").alias("what"))
    every = c.select("c_mktsegment", F.lit("all").alias("what")).unionByName(none).unionByName(calm)
    return every.groupBy("c_mktsegment").agg(*[F.count_if(F.col("what") == w).alias(n) for w, n in (("all", "customers"), ("none", "without_orders"), ("calm", "without_urgent"))])


def best_orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    """The three largest orders of each customer."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("place", F.row_number().over(w)).filter("place <= 3")


def orders_by_month(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderdate", "o_totalprice", "o_orderpriority")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def part_demand(spark: SparkSession, d: str) -> DataFrame:
    """Quantity ordered by brand, against the mean of its type."""
    q = table(spark, d, "lineitem", "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_type")
    g = q.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.sum("q").alias("quantity"))
    return g.withColumn("type_mean", F.round(F.avg("quantity").over(Window.partitionBy("p_type")), 4))


def inserted_vs_updated(spark: SparkSession, d: str) -> DataFrame:
    """Customers of orders against the customer table: what an upsert would do."""
    c = table(spark, d, "customer", "c_custkey", "c_acctbal").filter("c_acctbal > 0")
    o = table(spark, d, "orders", "o_custkey").distinct().withColumnRenamed("o_custkey", "c_custkey")
    return st.upsert_actions(c.select("c_custkey"), o, ["c_custkey"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def users_of_events(spark: SparkSession, d: str) -> DataFrame:
    """Per user: events, kinds, first and last time, and the kind of the largest value."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "ts", "value")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"), F.unix_micros(F.min("ts").cast("timestamp")).alias("first_us"), F.max_by("event_type", F.struct("value", "event_id")).alias("top_kind"))


def streamed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users by the streaming job, run over the events until all are read.

    Sessions that later events could still extend aren't out yet.
    """
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).parquet(f"{d}/events.parq*").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = jobs.streaming_bursts(s, "user_id", "ts")
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


QUERIES = {f.__name__: f for f in (pricing_summary, top_orders, revenue_by_nation, customers_without_orders, best_orders_per_customer, orders_by_month, part_demand, inserted_vs_updated, users_of_events, streamed_sessions)}

_REV = "l_extendedprice * (1 - l_discount)"
SQL = {
    "pricing_summary": f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({_REV}), 2) AS sum_paid, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "top_orders": f"SELECT l_orderkey, o_orderdate, round(sum({_REV}), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1, 2 ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "revenue_by_nation": f"SELECT r_name, n_name, round(sum(r), 2) AS revenue, count(*) AS suppliers FROM (SELECT l_suppkey, sum({_REV}) AS r FROM lineitem GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "customers_without_orders": """SELECT c_mktsegment, count(*) AS customers, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without_orders,
        count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) AS without_urgent FROM customer GROUP BY 1""",
    "best_orders_per_customer": "SELECT o_orderkey, o_custkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place FROM orders QUALIFY place <= 3",
    "orders_by_month": "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2",
    "part_demand": "WITH g AS (SELECT p_type, p_brand, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT *, round(avg(quantity) OVER (PARTITION BY p_type), 4) AS type_mean FROM g",
    "inserted_vs_updated": "SELECT CASE WHEN k IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'updated' ELSE 'inserted' END AS action, count(*) AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders) GROUP BY 1",
    "users_of_events": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, epoch_us(min(ts)) AS first_us, arg_max(event_type, struct_pack(v := value, e := event_id)) AS top_kind FROM events GROUP BY 1",
}

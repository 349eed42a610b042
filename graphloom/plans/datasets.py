"""Standard record sets and graphs over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import build


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def customers(spark: SparkSession, d: str) -> DataFrame:
    """One row a customer, with the distinct priorities of its orders as a list."""
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    prio = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").distinct().groupBy("c_custkey").agg(F.sort_array(F.collect_list("o_orderpriority")).alias("priority"))
    c = read(spark, d, "customer").join(nation, "c_nationkey", "left").join(prio, "c_custkey", "left")
    return c.select("c_name", "c_custkey", F.col("c_mktsegment").alias("segment"), "nation", F.col("c_acctbal").alias("acctbal"), "priority")


CUSTOMER = build.Config("c_name", "c_custkey", categorical=["segment", "nation"], numeric=["acctbal"], lists={"priority": ""})


def customer_graph(spark: SparkSession, d: str) -> build.Graph:
    return build.build(customers(spark, d), CUSTOMER)


def referral_graph(spark: SparkSession, d: str) -> build.Graph:
    """The customer graph with a direct edge to a synthetic referrer."""
    c = customers(spark, d)
    ref = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("referrer"))
    rows = c.join(ref, F.col("c_custkey") % 97 == ref.k, "left").drop("k")
    return build.build(rows, build.Config("c_name", "c_custkey", categorical=["segment"], relationships={"referrer": "REFERRED_BY"}))


def brands(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (id, value): brands that customers returned in quantity."""
    l = read(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 45").select("l_orderkey", "l_partkey")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("value"))
    c = read(spark, d, "customer").select("c_custkey", F.lower(F.concat(F.lit("entity:"), F.col("c_name"))).alias("id"))
    return l.join(o, "l_orderkey").join(p, "l_partkey").join(c, "c_custkey").select("id", "value").distinct()


def order_events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


ORDERS = build.Config("customer", "o_orderkey", categorical=["priority"], numeric=["price"], time_column="ts", outcome_column="status")


def messages(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("message_index"), F.to_json(F.struct("role", "text")).alias("message_data"), F.timestamp_seconds(F.lit(1700000000) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_at"))

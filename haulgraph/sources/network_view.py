"""The network view of the driver's tables: nodes, edges, branches, options, conversions, events. Integer keys become
coordinates by fixed arithmetic, so that any engine derives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulgraph.functions.geo import haversine_m


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat_of(key):
    return ((key * 7919) % 12001) / 100.0 - 60.0


def lon_of(key):
    return ((key * 104729) % 36000) / 100.0 - 180.0


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("country"), F.col("r_name").alias("continent"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").join(F.broadcast(countries(spark, sf_dir)), F.col("s_nationkey") == F.col("nationkey"))
    kind = F.col("s_suppkey") % 3
    return s.select(
        F.col("s_suppkey").alias("key"),
        F.when(kind == 0, "port").when(kind == 1, "gas_node").otherwise("liquid_node").alias("node_type"),
        F.when(kind == 1, F.concat(F.lit("PG_"), "nationkey")).when(kind == 2, F.concat(F.lit("PL_"), "nationkey")).alias("graph_id"),
        lat_of(F.col("s_suppkey")).alias("lat"), lon_of(F.col("s_suppkey")).alias("lon"), "country", "continent", (F.col("s_suppkey") % 7 != 0).alias("convertible"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive nodes of each network, in one direction."""
    order = Window.partitionBy("graph_id").orderBy("key")
    n = nodes(spark, sf_dir).filter("graph_id is not null")
    pairs = n.select("graph_id", F.col("key").alias("src"), F.lead("key").over(order).alias("dst")).filter("dst is not null")
    src, dst = F.col("src"), F.col("dst")
    return pairs.withColumn("distance_m", haversine_m(lat_of(src), lon_of(src), lat_of(dst), lon_of(dst)))


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("start_id"), lat_of(F.col("c_custkey")).alias("lat"), lon_of(F.col("c_custkey")).alias("lon"), (F.abs("c_acctbal") / 100 + 20).alias("cost"), F.col("c_nationkey").alias("nationkey"))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("branch_id"), (F.col("o_custkey") % 97).alias("node"), F.col("o_orderpriority").alias("commodity"), F.col("o_totalprice").alias("cost"), F.col("o_custkey").alias("start_id"), F.col("o_orderstatus").alias("status"))


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("node"), (F.col("l_quantity") * 1000).alias("distance_m"), F.col("l_discount").alias("rate"), F.col("l_tax").alias("loss"), F.col("l_returnflag").alias("mean"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as numbered steps of their order's route; line numbers repeat, so the rest decides between equals."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = read(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order))
    return li.select(F.col("l_orderkey").alias("route"), "n", F.col("l_suppkey").alias("node"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("total"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.col("event_type").alias("phase"), (F.col("user_id") % 5).alias("method"), F.col("value").alias("runtime_s"), k.alias("before"), (k % 50).alias("after"), (k - k % 50).alias("removed"))

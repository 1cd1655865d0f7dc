"""Sinks and sources: tables derived from the given ones are written to the shared folder and read back."""

from pyspark.sql import functions as F

from haulgraph.functions.geo import haversine_m
from haulgraph.plans.graphs import Written, place
from haulgraph.sources import files
from haulgraph.sources import network_view as V

from .registry import haversine, lat, lon, query, views


@query("SELECT p_partkey, p_name, p_retailprice, NULL::INT AS missing FROM part")
def csv_round_trip(spark, d):
    """Columns in a fixed order and type, absent ones null."""
    schema, path = "p_partkey long, p_name string, p_retailprice double, missing int", place(spark)
    files.write_csv(V.read(spark, d, "part"), path, schema)
    return files.csv(spark, path, schema)


@query(f"""SELECT a.n_name AS src, b.n_name AS dst, {haversine(lat("a.n_nationkey"), lon("a.n_nationkey"), lat("b.n_nationkey"), lon("b.n_nationkey"))} AS distance_m FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey""")
def matrix_round_trip(spark, d):
    """A square matrix of nations with an empty diagonal, as a text file and read back as pairs."""
    n = V.read(spark, d, "nation")
    at = lambda s: n.select(F.col("n_name").alias(s), V.lat_of(F.col("n_nationkey")).alias(f"{s}_lat"), V.lon_of(F.col("n_nationkey")).alias(f"{s}_lon"))
    pairs = at("src").crossJoin(F.broadcast(at("dst")))  # 25 nations
    far = pairs.filter("src <> dst").select("src", "dst", (haversine_m(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon")) - 0.25).alias("m"))
    path = place(spark)
    far.groupBy("src").pivot("dst").agg(F.first("m")).write.option("header", True).csv(path)
    return files.matrix(spark, path)


@query(f"SELECT n_name AS name, {lat('n_nationkey')} AS lat, {lon('n_nationkey')} AS lon FROM nation")
def geojson_round_trip(spark, d):
    """Points as one feature collection; a nation is a feature."""
    key, path = F.col("n_nationkey"), place(spark)
    point = F.struct(F.lit("Point").alias("type"), F.array(V.lon_of(key), V.lat_of(key)).alias("coordinates"))
    feature = F.struct(point.alias("geometry"), F.struct(F.col("n_name").alias("name")).alias("properties"))
    V.read(spark, d, "nation").agg(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features")).write.json(path)
    return files.geojson_points(spark, path).select(F.col("properties")["name"].alias("name"), "lat", "lon")


@query("SELECT event_id, event_id % 97 = 0 AS broken FROM events")
def event_log_errors(spark, d):
    """Telemetry as JSON lines, one of 97 cut short: the events read back, and the broken lines by their own account."""
    path = place(spark)
    whole = F.to_json(F.struct(F.col("event_id").cast("string").alias("location"), F.col("event_type").alias("phase"), F.col("value").alias("runtime_s")))
    cut = F.col("event_id") % 97 == 0
    V.read(spark, d, "events").select(F.when(cut, F.expr("concat('{\"location\": \"', event_id, '\", \"phase\"')")).otherwise(whole).alias("value")).write.text(path)
    good, bad = files.checked_events(spark, path)
    said = F.regexp_extract("value", "location\": \"([0-9]+)", 1).cast("long")
    return good.select(F.col("location").cast("long").alias("event_id"), F.lit(False).alias("broken")).unionByName(bad.select(said.alias("event_id"), F.lit(True).alias("broken")))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus AS scenario FROM orders WHERE o_orderstatus <> 'P'")
def status_by_scenario(spark, d):
    """Results appended by scenario; a filter on the scenario reads its folder only."""
    o, path = V.read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), place(spark)
    for status in ("F", "O", "P"):
        files.append_status(o.filter(F.col("o_orderstatus") == status).drop("o_orderstatus"), path, status)
    return spark.read.parquet(path).filter("scenario <> 'P'")


@query(f"{views('branches')} SELECT start_id, branch_id, cost FROM branches QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY cost, branch_id) = 1")
def best_state_snapshot(spark, d):
    """The best branch of each start as a snapshot that replaces an earlier one, sorted by cost."""
    from haulgraph.operators import state as S

    path, keep = place(spark), Written(spark)
    best = S.keep_best(V.branches(spark, d).select("start_id", "branch_id", "cost"), ["start_id"], ["cost", "branch_id"])
    first = keep.cut(best)
    files.snapshot(first.withColumn("cost", F.col("cost") + 1), path, "cost")
    files.snapshot(first, path, "cost")
    return spark.read.parquet(path)

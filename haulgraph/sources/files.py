"""Readers and writers with fixed schemas."""

from __future__ import annotations

import json
import math
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def with_columns(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Exactly the schema's columns, absent ones null."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).options(header=True, sep=sep, mode="FAILFAST").csv(path)


def csv_or_empty(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A typed empty table where the path does not exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return csv(spark, path, schema, sep) if there else empty(spark, schema)


def write_csv(df: DataFrame, path: str, schema: str) -> None:
    with_columns(df, schema).write.mode("overwrite").option("header", True).csv(path)


def matrix(spark: SparkSession, path: str, key: str = "src", sep: str = ",") -> DataFrame:
    """A square matrix as (src, dst, distance_m), rounded up; absent cells go."""
    wide = spark.read.options(header=True, sep=sep).csv(path)
    first, *rest = wide.columns
    long = wide.withColumnRenamed(first, key).unpivot(key, rest, "dst", "distance_m")
    return long.select(key, "dst", F.ceil(F.expr("try_cast(distance_m as double)")).cast("double").alias("distance_m")).filter("distance_m is not null")


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    feature = "struct<geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>"
    doc = spark.read.schema(f"type string, features array<{feature}>").option("multiLine", True).json(path)
    return doc.select(F.explode("features").alias("f")).select(F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.properties").alias("properties"))


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of arrays as pairs (node, other)."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("node", "others")).select("node", F.explode("others").alias("other"))


EVENT = "location string, time_since_location_start_s double, iteration int, phase string, method string, event string, before long, after long, created long, removed long, runtime_s double, details map<string,string>"


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a broken one fails the read."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines from 1 however the files are split.

    A first pass counts the lines of each split; a line's number is its place in its split after those of the splits before
    it. Both passes plan the same splits, in which rows keep the file's order.
    """
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    lines = spark.read.text(path).select("value", *at)
    splits = spark.read.text(path).select("value", *at).groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    begun = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.join(begun, ["file", "block"]).select("file", (F.col("row") + F.col("shift")).alias("line"), "value")


def checked_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events of JSON lines with their file and line, and the lines that are none (file, line, value). Blank lines are neither."""
    schema = T.StructType.fromDDL(EVENT).add("_broken", T.StringType())
    read = numbered_lines(spark, path).filter(F.trim("value") != "").withColumn("event", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    is_broken = F.col("event").isNull() | F.col("event._broken").isNotNull()
    return read.filter(~is_broken).select("file", "line", "event.*").drop("_broken"), read.filter(is_broken).select("file", "line", "value")


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of files, one location each, named by its id up to the first underscore."""
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("location", F.regexp_extract(F.input_file_name(), "([^/_]+)_[^/]*$", 1))


def safe_name(name: str, most: int = 120) -> str:
    clean = re.sub(r"[^\w.-]+", "_", name).strip("._") or "unnamed"
    stem, ending = os.path.splitext(clean)
    return stem[: most - len(ending)] + ending


def partitioned(df: DataFrame, *by: str, path: str | None = None) -> DataFrame:
    """``df`` written by folders of ``by`` and read again; filters on them list only their folders."""
    from haulgraph.plans.graphs import place

    path = path or place(df.sparkSession)
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_status(df: DataFrame, path: str, scenario: str) -> None:
    """Results with their status added to a table by scenario; what other scenarios wrote stays."""
    df.withColumn("scenario", F.lit(scenario)).write.mode("append").partitionBy("scenario").parquet(path)


def snapshot(df: DataFrame, path: str, *order: str) -> None:
    """The whole table in place of the last snapshot, sorted by range over its files.

    It is written beside the last one, which goes only when the new one is whole; a job that fails leaves the last one there.
    """
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.parquet(new)
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"{path}: the last snapshot cannot be moved")
    if not fs.rename(at(new), at(path)):
        raise OSError(f"{new}: the new snapshot cannot take its place; the last one is in {old}")
    fs.delete(at(old), True)


def append_events(spark: SparkSession, path: str, events: list[dict]) -> None:
    """Telemetry records of a driver added as JSON lines; numbers that are not finite become text."""
    odd = lambda v: isinstance(v, float) and not math.isfinite(v)
    lines = [(json.dumps({k: str(v) if odd(v) else v for k, v in e.items()}),) for e in events]
    if lines:
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(path)


def write_adjacency(pairs: DataFrame, path: str, node: str, other: str) -> None:
    """Pairs as one JSON record of a node and its sorted others a line."""
    pairs.groupBy(node).agg(F.array_sort(F.collect_set(other)).alias("others")).write.mode("overwrite").json(path)


def finish(spark: SparkSession, path: str) -> None:
    """A completion marker, by which a later run skips what is done."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_DONE")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True).close()


def finished(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_DONE")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

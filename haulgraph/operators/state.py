"""Dominance, upserts and top rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key; Spark limits groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def not_dominated(df: DataFrame, best: DataFrame, keys: list[str], cost: str, strict: bool = False) -> DataFrame:
    """Rows no dearer than the known best of their key (with ``strict``: cheaper)."""
    known = best.select(*keys, F.col(cost).alias("_best"))
    better = F.col(cost) < F.col("_best") if strict else F.col(cost) <= F.col("_best")
    return df.join(known, keys, "left").filter(F.col("_best").isNull() | better).drop("_best")


def upsert_best(best: DataFrame, rows: DataFrame, keys: list[str], cost: str, tie: str) -> DataFrame:
    return keep_best(best.unionByName(rows), keys, [cost, tie])


def within_bound(df: DataFrame, bounds: DataFrame, key: str, cost: str) -> DataFrame:
    known = bounds.select(key, F.col("bound").alias("_bound"))
    return df.join(known, key, "left").filter(F.col(cost) <= F.coalesce("_bound", F.lit(float("inf")))).drop("_bound")


def undirected(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    others = [c for c in edges.columns if c not in (a, b)]
    return edges.unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b), *others))

"""Running sums whose order is spread over tasks: a key with most of the rows is no single task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import keep_best


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], keep) -> DataFrame:
    """``df`` with, for each ``new: column`` of ``sums``, the sum of the column over the key's rows up to this one.

    Rows are dealt by ranges of key and order and written, so a key lies in consecutive parts; each part's sums begin where
    the parts before it end, which takes one row for each part and key. Rows that are equal in ``order`` are in one part and
    come in any order. Nulls count as 0.
    """
    dealt = keep.cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "_part").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(f"_{n}") for n, c in sums.items()))
    begun = totals.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k_{k}") for k in keys), *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums))
    so_far = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.select("*", *(F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(f"_o_{n}") for n, c in sums.items()))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return own.join(begun, same).select(*df.columns, *((F.col(f"_o_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def two_least(at: DataFrame, offers: DataFrame, keys: list[str], x: str, rate: float) -> DataFrame:
    """``at`` (keys, x) with ``best``: the two least (cost, name), if as many, cost = value + rate * distance along x, of its keys' offers (keys, x, value, name).

    On either side the order of offers is that of value - rate * x (below) or value + rate * x (above), so one pass each way
    over the distinct places stands for all pairs: the least so far, and the least of those that lost against it.
    """
    few = keep_best(offers.select(*keys, x, F.col("value").cast("double").alias("_v"), F.col("name").alias("_name")), [*keys, x], ["_v", "_name"], 2)
    rows = few.withColumn("_at", F.lit(False)).unionByName(at.select(*keys, x).distinct().withColumn("_at", F.lit(True)), allowMissingColumns=True)

    def side(df: DataFrame, name: str, order, sign: int) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(order, "_at", "_v", "_name")
        here, before = window.rowsBetween(Window.unboundedPreceding, Window.currentRow), window.rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_o", F.when(~F.col("_at"), F.struct((F.col("_v") - sign * rate * F.col(x)).alias("o"), F.col("_name").alias("n"), F.col("_v").alias("v"), F.col(x).alias("x"))))
        first = df.withColumns({f"{name}1": F.min("_o").over(here), "_p": F.min("_o").over(before)})
        lost = F.when(F.col("_o").isNotNull() & F.col("_p").isNotNull(), F.greatest("_o", "_p"))
        return first.withColumn("_l", lost).withColumn(f"{name}2", F.min("_l").over(here)).drop("_o", "_p", "_l")

    both = side(side(rows, "_b", F.col(x).asc(), 1), "_a", F.col(x).desc(), -1).filter("_at")
    cost = lambda t: F.struct((t["v"] + F.abs(F.col(x) - t["x"]) * rate).alias("cost"), t["n"].alias("name"))
    four = F.array_sort(F.transform(F.filter(F.array("_b1", "_b2", "_a1", "_a2"), lambda t: t.isNotNull()), cost))
    ranked = both.select(*keys, x, four.alias("_four"))
    second = F.slice(F.filter("_four", lambda t: t["name"] != F.col("_four")[0]["name"]), 1, 1)
    return ranked.select(*keys, x, F.concat(F.slice("_four", 1, 1), second).alias("best"))

"""Lower bounds, entry probes, ancestry and the commodity-expanded edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgraph.operators import state as S

from .graphs import cut


def destination_bound(branches: DataFrame, conversions: DataFrame, rates: DataFrame) -> DataFrame:
    """The least a branch (branch_id, commodity, cost, left_m) can still pay: convert, go straight, convert again.

    conversions: c_from, c_to, fee, efficiency, with a free one of each commodity into itself; rates: commodity, rate per
    1000 km. Every part is the cheapest anywhere, so the bound is admissible.
    """
    first = conversions.select(F.col("c_from").alias("commodity"), F.col("c_to").alias("via"), F.col("fee").alias("fee1"), F.col("efficiency").alias("eff1"))
    carried = branches.join(F.broadcast(first), "commodity").join(F.broadcast(rates.withColumnRenamed("commodity", "via")), "via")
    cost = (F.col("cost") + F.col("fee1")) / F.col("eff1") + F.col("left_m") / 1e6 * F.col("rate")
    last = conversions.groupBy(F.col("c_from").alias("via")).agg(F.min(F.struct("fee", "efficiency")).alias("x")).select("via", F.col("x.fee").alias("fee2"), F.col("x.efficiency").alias("eff2"))
    done = carried.withColumn("total", cost).join(F.broadcast(last), "via")
    return done.groupBy("branch_id").agg(F.min((F.col("total") + F.col("fee2")) / F.col("eff2")).alias("bound"))


def propagate(bounds: DataFrame, conversions: DataFrame) -> DataFrame:
    """Bounds (commodity, bound) carried over conversions until none falls. A few commodities; the loop is short."""
    best = cut(bounds.select("commodity", "bound"))
    while True:
        over = best.join(conversions, F.col("commodity") == F.col("c_from")).select(F.col("c_to").alias("commodity"), ((F.col("bound") + F.col("fee")) / F.col("efficiency")).alias("bound"))
        new = cut(best.unionByName(over).groupBy("commodity").agg(F.min("bound").alias("bound")))
        if new.join(best.withColumnRenamed("bound", "old"), "commodity", "left").filter("old is null or bound < old").isEmpty():
            return new
        best = new


def probe_entries(entries: DataFrame, routes: DataFrame, k: int = 5, slack: float = 1.00001) -> DataFrame:
    """Entries (branch_id, graph_id, node, cost) that no cheap entry of their network reaches more cheaply.

    The ``k`` cheapest of each network go through it first (routes: src, dst, fee); an entry goes if one of them arrives
    at its node for less, at ``slack`` times the cost.
    """
    probes = S.keep_best(entries, ["graph_id"], ["cost", "branch_id"], k)
    arrive = probes.select(F.col("node").alias("src"), F.col("cost").alias("paid")).join(routes, "src").groupBy(F.col("dst").alias("node")).agg(F.min((F.col("paid") + F.col("fee")) * slack).alias("arrival"))
    return entries.join(arrive, "node", "left").filter("arrival is null or cost <= arrival").drop("arrival")


def without_descendants(branches: DataFrame, invalid: DataFrame) -> DataFrame:
    """Branches (branch_id, ancestors array) none of whose ancestors is in ``invalid`` (branch_id)."""
    gone = branches.select("branch_id", F.explode("ancestors").alias("a")).join(invalid.select(F.col("branch_id").alias("a")), "a", "left_semi").select("branch_id").distinct()
    return branches.join(gone, "branch_id", "left_anti")


def model_edges(segments: DataFrame, rates: DataFrame, conversions: DataFrame) -> DataFrame:
    """Edges of the commodity-expanded graph: (kind, src, dst, fee, loss), nodes named ``node+commodity``."""
    name = lambda n, c: F.concat_ws("+", F.col(n).cast("string"), F.col(c).cast("string"))
    moves = segments.join(F.broadcast(rates), "mean").select(F.lit("transport").alias("kind"), name("src", "commodity").alias("src"), name("dst", "commodity").alias("dst"), (F.col("distance_m") / 1e6 * F.col("rate")).alias("fee"), F.lit(0.0).alias("loss"))
    turns = conversions.select(F.lit("conversion").alias("kind"), name("node", "c_from").alias("src"), name("node", "c_to").alias("dst"), F.col("fee"), (1 - F.col("efficiency")).alias("loss"))
    return moves.unionByName(turns)


def affordable(edges: DataFrame, limit: float, production: float) -> DataFrame:
    """Edges that a route within a known one's cost can hold."""
    return edges.filter((F.col("fee") + production) / F.greatest(1 - F.col("loss"), F.lit(1e-9)) <= limit)


def area_weighted(cells: DataFrame, boxes: DataFrame, size: float = 0.25) -> DataFrame:
    """Each box's cost, weighted by quantity over the share of each cell inside it, else by area alone, else infinite.

    cells: cell_lat, cell_lon (centres of a grid of ``size``), cost, quantity. boxes: id, south, north, west, east. Boxes
    list the cells they touch, so the join is on equal cells.
    """
    step = lambda lo, hi: F.sequence(F.round(F.col(lo) / size).cast("int"), F.round(F.col(hi) / size).cast("int"))
    touched = boxes.withColumn("i", F.explode(step("south", "north"))).withColumn("j", F.explode(step("west", "east")))
    grid = cells.withColumn("i", F.round(F.col("cell_lat") / size).cast("int")).withColumn("j", F.round(F.col("cell_lon") / size).cast("int"))
    side = lambda lo, hi, at: F.greatest(F.least(F.col(hi), (F.col(at) + 0.5) * size) - F.greatest(F.col(lo), (F.col(at) - 0.5) * size), F.lit(0.0))
    area = side("south", "north", "i") * side("west", "east", "j")
    met = touched.join(grid, ["i", "j"]).withColumn("area", area).groupBy("id").agg(F.sum(F.col("area") * F.col("quantity")).alias("w"), F.sum(F.col("area") * F.col("quantity") * F.col("cost")).alias("wc"), F.sum("area").alias("a"), F.sum(F.col("area") * F.col("cost")).alias("ac"))
    cost = F.when(F.col("w") > 0, F.col("wc") / F.col("w")).when(F.col("a") > 0, F.col("ac") / F.col("a")).otherwise(F.lit(float("inf")))
    return boxes.select("id").join(met, "id", "left").select("id", cost.alias("cost"))

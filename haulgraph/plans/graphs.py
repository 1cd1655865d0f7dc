"""Iterative graph operators: each step is a join and an aggregate, written to the shared folder to cut its lineage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def place(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; a local session without one gets its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir: a folder that the driver and all executors share")
        top = "/tmp/checkpoints"
    return f"{top.rstrip('/')}/haulgraph-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the cluster's shared checkpoint folder; a lost executor costs nothing that is written."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Written:
    """Tables written to the shared folder by one run; ``drop`` removes those read no more, the driver's exit the rest."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, place(spark), 0
        atexit.register(self.close)

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._remove(df._written)

    def close(self) -> None:
        self._remove(self.root)

    def _remove(self, path: str) -> None:
        try:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone at exit; only clean-up is lost
            pass


def _least(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("cost").alias("cost"))


def _pass_on(best: DataFrame, edges: DataFrame, add) -> DataFrame:
    met = best.join(edges.select(F.col("src").alias("node"), "dst", F.col("cost").alias("more")), "node")
    return met.select("source", F.col("dst").alias("node"), add(F.col("cost"), F.col("more")).alias("cost"))


def _waves(edges: DataFrame, best: DataFrame, add) -> DataFrame:
    """``best`` (source, node, cost) carried over edges (src, dst, cost), an edge a round, until no cost falls."""
    front = best
    while True:
        step = _least(_pass_on(front, edges, add), "source", "node")
        front = cut(step.join(best.withColumnRenamed("cost", "known"), ["source", "node"], "left").filter("known is null or cost < known").drop("known"))
        if front.isEmpty():
            return best
        best = cut(_least(best.unionByName(front), "source", "node"))


def leaving(edges: DataFrame, level: int) -> DataFrame | None:
    """(node): nodes of at most two neighbours, no two beside each other, that can leave a graph at once; none if all have more."""
    live = edges.filter("src <> dst")
    both = live.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(live.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()
    small = both.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n <= 2").select("node", F.struct(F.xxhash64("node", F.lit(level)), "node").alias("h"))
    small = cut(small)
    if small.isEmpty():
        return None
    held = both.join(small, "node").join(small.select(F.col("node").alias("other"), F.col("h").alias("h2")), "other").filter("h2 < h").select("node")
    return cut(small.select("node").join(held, "node", "left_anti"))


def _thin_out(edges: DataFrame, add) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Levels of nodes that leave a graph, each the edges from them and to them as they left; and the edges that remain.

    A node with at most two neighbours leaves if no such neighbour has a lesser hash, and each pair of its edges becomes one
    edge past it, so costs between the others stay. Chains and trees vanish in logarithmic rounds.
    """
    levels, live = [], cut(_least(edges.filter("src <> dst"), "src", "dst"))
    while True:
        gone = leaving(live, len(levels))
        if gone is None:
            return levels, live
        src, dst = (gone.withColumnRenamed("node", c) for c in ("src", "dst"))
        out, into = cut(live.join(src, "src", "left_semi")), cut(live.join(dst, "dst", "left_semi"))
        levels.append((out, into))
        past = _pass_on(into.select(F.col("src").alias("source"), F.col("dst").alias("node"), "cost"), out, add).filter("source <> node").toDF("src", "dst", "cost")
        live = cut(_least(live.join(src, "src", "left_anti").join(dst, "dst", "left_anti").unionByName(past), "src", "dst"))


def shortest(edges: DataFrame, sources: DataFrame, none=None, add=lambda a, b: a + b) -> DataFrame:
    """(source, node, cost): cheapest costs from every source (source, node) over directed edges (src, dst, cost), none below 0.

    Nodes with at most two neighbours leave first, level by level. Sources climb the levels, what remains is crossed an edge a
    round, and costs come down again, each level from those above: every cheapest way climbs, crosses and comes down. So
    chains take rounds by the logarithm of their length. ``none``: the cost of staying at a node; ``add``: of two ways in a row.
    """
    levels, core = _thin_out(edges, add)
    best = cut(sources.select("source", "node", (F.lit(0.0) if none is None else none).alias("cost")).distinct())
    for out, _ in levels:
        best = cut(_least(best.unionByName(_pass_on(best, out, add)), "source", "node"))
    best = _waves(core, best, add)
    for _, into in reversed(levels):
        best = cut(_least(best.unionByName(_pass_on(best, into, add)), "source", "node"))
    return best


def components(edges: DataFrame) -> DataFrame:
    """(node, root) over undirected edges (src, dst): root is the least node reachable.

    Nodes hook to their least neighbour, paths to roots are halved by self joins, edges are contracted; rounds are
    logarithmic, not the diameter. Written tables of nodes look small to Spark, but as a table in memory they are not: joins
    are merges, so none goes through the driver.
    """
    pair = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    live = cut(edges.filter("src <> dst").select(*pair).distinct())
    labels = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    while not live.isEmpty():
        parent = cut(live.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("p")))
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            parent = cut(parent.join(up.hint("merge"), "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            if parent.filter("moved").isEmpty():
                break
            parent = parent.drop("moved")
        to = parent.select(F.col("u").alias("root"), F.col("p").alias("next"))
        labels = cut(labels.join(to.hint("merge"), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        a, b = (parent.select(F.col("u").alias(c), F.col("p").alias(f"{c}p")) for c in "ab")
        moved = live.join(a.hint("merge"), "a", "left").join(b.hint("merge"), "b", "left").select(F.coalesce("ap", "a").alias("src"), F.coalesce("bp", "b").alias("dst"))
        live = cut(moved.filter("src <> dst").select(*pair).distinct())
    return labels


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node): everything that directed edges (src, dst) reach from sources (node), themselves included."""
    seen = cut(sources.select("node").distinct())
    front = seen
    while True:
        front = cut(front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def on_some_path(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges on some path from a start to an end."""
    ahead = reachable(edges, starts)
    back = reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends)
    return edges.join(ahead.withColumnRenamed("node", "src"), "src", "left_semi").join(back.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def fewest_hops(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, hops, path): a path of fewest edges, the least of equals, from each source (source, node).

    Hops and then the nodes in order are a cost that adds up: of two ways between the same nodes the same one stays the
    lesser whatever comes before and after.
    """
    way = lambda n, path: F.struct(n.cast("int").alias("hops"), path.alias("path"))
    steps = edges.select("src", "dst", way(F.lit(1), F.array("dst")).alias("cost"))
    found = shortest(steps, sources, way(F.lit(0), F.array("node")), lambda a, b: way(a["hops"] + b["hops"], F.concat(a["path"], b["path"])))
    return found.select("source", "node", "cost.hops", "cost.path")


def contract(edges: DataFrame, short: float) -> DataFrame:
    """Edges (src, dst, distance_m) between the groups that edges under ``short`` tie together, the shortest of parallel ones."""
    group = cut(components(edges.filter(F.col("distance_m") < short).select("src", "dst")))
    a, b = (group.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("src", "dst"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("src_root", "src").alias("a"), F.coalesce("dst_root", "dst").alias("b"), "distance_m").filter("a <> b")
    return moved.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("distance_m").alias("distance_m"))

"""Cheapest supply routes: branches expand, pay, face bounds and dominance until none is left, for all starts at once."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulgraph.functions import cost as C
from haulgraph.operators import state as S

from .graphs import Written, cut, leaving

STATE = ["start_id", "node", "commodity"]


def expand(front: DataFrame, conversions: DataFrame, segments: DataFrame) -> DataFrame:
    """Each branch converts at its node, or moves along a segment that takes its commodity.

    front: start_id, node, commodity, cost, hops. conversions: node, commodity, to, fee, efficiency. segments: src, dst,
    commodity, fee, loss.
    """
    turned = front.join(conversions, ["node", "commodity"]).select("start_id", "node", F.col("to").alias("commodity"), C.convert(F.col("cost"), F.col("fee"), F.col("efficiency")).alias("cost"), (F.col("hops") + 1).alias("hops"))
    moved = front.join(segments.withColumnRenamed("src", "node"), ["node", "commodity"]).select("start_id", F.col("dst").alias("node"), "commodity", ((F.col("cost") + F.col("fee")) / (1 - F.col("loss"))).alias("cost"), (F.col("hops") + 1).alias("hops"))
    return turned.unionByName(moved)


def search(seeds: DataFrame, conversions: DataFrame, segments: DataFrame, goals: DataFrame, most: int | None = None, prune: bool = True) -> DataFrame:
    """Best states (start_id, node, commodity, cost, hops), once no branch is left or after ``most`` steps, if given.

    Without ``most`` it ends as no step lowers a cost: only a cheaper arrival goes on.

    With ``prune``, a branch dearer than its start's best arrival at a goal (node) goes: no step lowers a cost, so no such
    branch can arrive cheaper. States are kept by least cost, equal costs by fewer hops.
    """
    best = cut(S.keep_best(seeds.select(*STATE, "cost", F.lit(0).alias("hops")), STATE, ["cost"]))
    front = best
    for _ in itertools.count() if most is None else range(most):
        grown = expand(front, conversions, segments).filter(C.is_finite(F.col("cost")))
        if prune:
            bound = best.join(goals, "node", "left_semi").groupBy("start_id").agg(F.min("cost").alias("bound"))
            grown = S.within_bound(grown, bound, "start_id", "cost")
        grown = S.keep_best(grown, STATE, ["cost", "hops"])
        front = cut(S.not_dominated(grown, best, STATE, "cost", strict=True))
        if front.isEmpty():
            break
        best = cut(S.keep_best(best.unionByName(front), STATE, ["cost", "hops"]))
    return best


WAY = ["src", "commodity", "dst", "to"]


def _lowest(ways: DataFrame, least: float, most: float | None = None) -> DataFrame:
    """Of ways (WAY, slope, base, fresh), those that some cost from ``least`` up to ``most`` may have as the cheapest; of equals one that is not fresh."""
    far = F.col("slope") if most is None else F.col("slope") * most + F.col("base")
    order = Window.partitionBy(*WAY).orderBy(F.col("slope") * least + F.col("base"), far, "fresh").rowsBetween(Window.unboundedPreceding, -1)
    return ways.withColumn("_far", far).withColumn("_f", F.min("_far").over(order)).filter("_f is null or _far < _f - abs(_f) * 1e-13").drop("_far", "_f")


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ways of ``first`` with one of ``second`` after them."""
    after = second.select(F.col("src").alias("dst"), F.col("commodity").alias("to"), F.col("dst").alias("_dst"), F.col("to").alias("_to"), F.col("slope").alias("_slope"), F.col("base").alias("_base"))
    met = first.join(after.hint("merge"), ["dst", "to"])
    return met.select("src", "commodity", F.col("_dst").alias("dst"), F.col("_to").alias("to"), (F.col("slope") * F.col("_slope")).alias("slope"), (F.col("base") * F.col("_slope") + F.col("_base")).alias("base"), F.lit(True).alias("fresh"))


def _on(keep: Written, ways: DataFrame, steps: DataFrame, least: float, most: float | None = None, again: bool = True) -> DataFrame:
    """``ways``, a written table read no more after this, and those that go on by ``steps``, with ``again`` as often as they gain something."""
    best = front = ways
    while True:
        old, best = best, keep.cut(_lowest(best.withColumn("fresh", F.lit(False)).unionByName(_then(front, steps)), least, most))
        keep.drop(old)
        front = best.filter("fresh")
        if not again or front.isEmpty():
            return best


def reached(seeds: DataFrame, conversions: DataFrame, segments: DataFrame) -> DataFrame:
    """(start_id, node, commodity, cost): every state that conversions and segments lead to, at its least cost, without bounds.

    A way turns a cost x into slope * x + base, so ways are worked out once for all starts of a node. Nodes of at most two
    neighbours leave level by level, with the ways past them; the conversions at a node, and what its left neighbours add to
    them, are ways from it to itself. Sources climb the levels, cross what remains and come down, as in ``graphs.shortest``: chains
    take rounds by the logarithm of their length, and what is written grows with the result. No step may lower a cost.
    """
    seeds = seeds.filter(C.is_finite(F.col("cost")))
    ends = seeds.agg(F.min("cost").alias("least"), F.max("cost").alias("most")).first()
    least, most = float(ends["least"] or 0.0), float(ends["most"] or 0.0)
    step = lambda df, src, dst, c, to, share: df.select(F.col(src).alias("src"), F.col(c).alias("commodity"), F.col(dst).alias("dst"), F.col(to).alias("to"), (1 / share).alias("slope"), (F.col("fee") / share).alias("base"), F.lit(False).alias("fresh")).filter("slope > 0 and slope < double('infinity') and base < double('infinity')")
    keep = Written(seeds.sparkSession)
    live = keep.cut(_lowest(step(conversions, "node", "node", "commodity", "to", F.col("efficiency")).unionByName(step(segments, "src", "dst", "commodity", "commodity", 1 - F.col("loss"))), least))
    levels = []
    while (gone := leaving(live, len(levels))) is not None:
        src, dst = (gone.withColumnRenamed("node", c) for c in ("src", "dst"))
        own, turns = live.join(src, "src", "left_semi"), "src = dst"
        turned = _on(keep, keep.cut(own.filter(turns)), own.filter(turns), least)
        out = keep.cut(own.filter("src <> dst"))
        into = _on(keep, keep.cut(live.join(dst, "dst", "left_semi").filter("src <> dst")), turned, least, again=False)
        levels.append((turned, out, into))
        past = _then(into, out).filter("src <> dst or commodity <> to")
        old, live = live, keep.cut(_lowest(live.join(src, "src", "left_anti").join(dst, "dst", "left_anti").unionByName(past), least))
        keep.drop(old)
    one = lambda x: F.lit(x).cast("double")
    best = keep.cut(seeds.select(F.col("node").alias("src"), "commodity").distinct().select("src", "commodity", F.col("src").alias("dst"), F.col("commodity").alias("to"), one(1.0).alias("slope"), one(0.0).alias("base"), F.lit(False).alias("fresh")))
    for turned, out, _ in levels:
        best = _on(keep, _on(keep, best, turned, least, most, False), out, least, most, False)
        keep.drop(turned, out)
    best = _on(keep, best, live, least, most)
    for _, _, into in reversed(levels):
        best = _on(keep, best, into, least, most, False)
        keep.drop(into)
    return _arrive(seeds.withColumnRenamed("node", "src"), best)


def _arrive(seeds: DataFrame, ways: DataFrame) -> DataFrame:
    """The least cost (start_id, node, commodity, cost) that seeds (start_id, src, commodity, cost) come to by ``ways``.

    A start's rows are many times its ways, so they are not dealt again: the ways between two states meet a seed as one list.
    Only starts with several seeds have rows to compare.
    """
    at = ["src", "commodity"]
    lists = ways.repartition(*at).groupBy(*WAY).agg(F.collect_list(F.struct("slope", "base")).alias("lines"))
    twice = cut(seeds.groupBy("start_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("start_id"))
    cost = F.array_min(F.transform("lines", lambda x: x["slope"] * F.col("cost") + x["base"]))
    arrived = lambda s: s.join(lists.hint("merge"), at).select("start_id", F.col("dst").alias("node"), F.col("to").alias("commodity"), cost.alias("cost"))
    if twice.isEmpty():
        return arrived(seeds)
    several = arrived(seeds.join(twice, "start_id", "left_semi")).groupBy("start_id", "node", "commodity").agg(F.min("cost").alias("cost"))
    return arrived(seeds.join(twice, "start_id", "left_anti")).unionByName(several)


KEY = ["start_id", "node", "commodity", "free"]
FULL = [*KEY, "cost", "hops", "shipped", "visited", "riding"]


def steps(front: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Everything a branch may do next, under the rules of its state.

    conversions (node, commodity, to, fee, efficiency) turn it. segments (node, dst, commodity, network, fee, loss) are
    ridden within the network it rides, or one it has not visited. transfers (node, dst) are free. connectors (node, dst,
    commodity, fee) are not taken twice in a row. ships (node, dst, commodity, fee, loss) are taken once.
    """
    hops, none = (F.col("hops") + 1).alias("hops"), F.lit(None).cast("string").alias("riding")
    at = ["node", "commodity"]
    moved = F.col("dst").alias("node")
    paid = ((F.col("cost") + F.col("fee")) / (1 - F.col("loss"))).alias("cost")
    turned = front.join(tables["conversions"], at).select("start_id", "node", F.col("to").alias("commodity"), "free", C.convert(F.col("cost"), F.col("fee"), F.col("efficiency")).alias("cost"), hops, "shipped", "visited", "riding")
    may = F.col("network").eqNullSafe(F.col("riding")) | ~F.array_contains("visited", F.col("network"))
    been = F.array_sort(F.array_union("visited", F.array("network"))).alias("visited")
    ridden = front.join(tables["segments"], at).filter(may).select("start_id", moved, "commodity", F.lit(True).alias("free"), paid, hops, "shipped", been, F.col("network").alias("riding"))
    crossed = front.join(tables["transfers"], "node").select("start_id", moved, "commodity", "free", "cost", hops, "shipped", "visited", none)
    joined = front.filter("free").join(tables["connectors"], at).select("start_id", moved, "commodity", F.lit(False).alias("free"), (F.col("cost") + F.col("fee")).alias("cost"), hops, "shipped", "visited", none)
    sailed = front.filter("not shipped").join(tables["ships"], at).select("start_id", moved, "commodity", F.lit(True).alias("free"), paid, hops, F.lit(True).alias("shipped"), "visited", none)
    return turned.unionByName(ridden).unionByName(crossed).unionByName(joined).unionByName(sailed)


def least_fee(tables: dict[str, DataFrame], goals: DataFrame) -> DataFrame:
    """(node, lower): what leaving a node costs at least, whatever is carried; nothing at goals."""
    fees = [tables[t].select("node", "fee") for t in ("segments", "connectors", "ships")] + [tables["transfers"].select("node", F.lit(0.0).alias("fee")), goals.select("node", F.lit(0.0).alias("fee"))]
    every = fees[0]
    for f in fees[1:]:
        every = every.unionByName(f)
    return every.groupBy("node").agg(F.min("fee").alias("lower"))


def fixpoint(seeds: DataFrame, tables: dict[str, DataFrame], goals: DataFrame, prune: bool = True) -> DataFrame:
    """Best states (FULL) of every start under all rules, once no branch is left.

    A state's key is its node, commodity and whether a connector may follow; of equal keys the cheapest stays, with its
    visited networks and whether it shipped (equal costs: fewer hops, not shipped, the lesser list). With ``prune``, a
    branch goes whose cost and least fee ahead exceed its start's best arrival: no step lowers a cost, so it cannot arrive
    cheaper. seeds: start_id, node, commodity, cost.
    """
    order = ["cost", "hops", "shipped", "visited"]
    first = seeds.select("start_id", "node", "commodity", F.lit(True).alias("free"), "cost", F.lit(0).alias("hops"), F.lit(False).alias("shipped"), F.array().cast("array<string>").alias("visited"), F.lit(None).cast("string").alias("riding"))
    best = cut(S.keep_best(first, KEY, order))
    lower = cut(least_fee(tables, goals))
    front = best
    while True:
        grown = steps(front, tables).filter(C.is_finite(F.col("cost")))
        if prune:
            bound = best.join(goals, "node", "left_semi").groupBy("start_id").agg(F.min("cost").alias("bound"))
            ahead = grown.join(lower, "node").withColumn("_least", F.col("cost") + F.col("lower"))
            grown = S.within_bound(ahead, bound, "start_id", "_least").select(FULL)
        front = cut(S.not_dominated(S.keep_best(grown, KEY, order), best, KEY, "cost", strict=True))
        if front.isEmpty():
            return best
        best = cut(S.keep_best(best.unionByName(front), KEY, order))

"""Aggregates, windows and result tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from haulgraph.operators import state as S
from haulgraph.plans import results as R
from haulgraph.sources import network_view as V

from .registry import query, views

def _n():
    return F.count(F.lit(1)).alias("n")



@query("SELECT l_suppkey AS segment, l_returnflag AS mean, round(sum(l_quantity * (1 - l_discount)), 4) AS flow FROM lineitem GROUP BY ALL")
def flow_sum(spark, d):
    return V.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("segment"), F.col("l_returnflag").alias("mean")).agg(F.round(F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))), 4).alias("flow"))


@query(f"{views('telemetry')} SELECT phase, method, count(*) AS n, round(sum(runtime_s), 4) AS total, round(avg(runtime_s), 6) AS mean, max(runtime_s) AS most, sum(removed)::BIGINT AS removed, round(sum(removed) / nullif(sum(before), 0), 6) AS share FROM telemetry GROUP BY ALL")
def runtime_summary(spark, d):
    return R.runtime_summary(V.telemetry(spark, d), ["phase", "method"])


@query(f"{views('telemetry')} SELECT phase, method, n, total FROM (SELECT phase, method, count(*) AS n, round(sum(runtime_s), 4) AS total FROM telemetry GROUP BY GROUPING SETS ((phase), (method), ()))")
def summary_grouping_sets(spark, d):
    V.telemetry(spark, d).createOrReplaceTempView("telemetry_view")
    return spark.sql("SELECT phase, method, count(*) AS n, round(sum(runtime_s), 4) AS total FROM telemetry_view GROUP BY GROUPING SETS ((phase), (method), ())")


@query(f"{views('options')} SELECT mean, loss, count(*) AS n FROM options GROUP BY ROLLUP (mean, loss)")
def type_rollup(spark, d):
    return V.options(spark, d).rollup("mean", "loss").agg(_n())


@query("SELECT l_suppkey % 10 AS node, list_sort(list(DISTINCT l_partkey % 20)) AS neighbours FROM lineitem GROUP BY 1")
def adjacency_collect(spark, d):
    return V.read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("node")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 20)).alias("neighbours"))


@query(f"{views('branches')} SELECT commodity, max(best) AS bound FROM (SELECT commodity, node, min(cost) AS best FROM branches GROUP BY ALL) GROUP BY commodity HAVING count(*) = (SELECT count(DISTINCT node) FROM branches)")
def complete_group_max(spark, d):
    b = V.branches(spark, d)
    n = b.select("node").distinct().agg(F.count(F.lit(1)).alias("all_nodes"))
    best = b.groupBy("commodity", "node").agg(F.min("cost").alias("best")).groupBy("commodity").agg(F.max("best").alias("bound"), _n())
    return best.join(F.broadcast(n), F.col("n") == F.col("all_nodes")).select("commodity", "bound")


@query(f"{views('options')} SELECT mean, n % 3 AS kind, min(rate) AS rate, min(loss) AS loss FROM options GROUP BY ALL")
def min_per_pair(spark, d):
    return V.options(spark, d).groupBy("mean", (F.col("n") % 3).alias("kind")).agg(F.min("rate").alias("rate"), F.min("loss").alias("loss"))


@query("SELECT c_nationkey AS k, round(CASE WHEN sum(greatest(c_acctbal, 0)) > 0 THEN sum(greatest(c_acctbal, 0) * (c_custkey % 13)) / sum(greatest(c_acctbal, 0)) ELSE avg(c_custkey % 13) END, 6) AS x FROM customer GROUP BY 1")
def weighted_average_fallback(spark, d):
    w, x = F.greatest(F.col("c_acctbal"), F.lit(0.0)), F.col("c_custkey") % 13
    return V.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.when(F.sum(w) > 0, F.sum(w * x) / F.sum(w)).otherwise(F.avg(x)), 6).alias("x"))


@query("SELECT o_orderpriority AS k, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(quantile_cont(o_totalprice, 0.75) + 1.5 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)), 4) AS fence FROM orders GROUP BY 1")
def tukey_fence(spark, d):
    q1, q3 = F.percentile("o_totalprice", F.lit(0.25)), F.percentile("o_totalprice", F.lit(0.75))
    return V.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(q1, 4).alias("q1"), F.round(q3, 4).alias("q3"), F.round(q3 + 1.5 * (q3 - q1), 4).alias("fence"))


@query(f"{views('options')}, e AS (SELECT mean, greatest(1, ceil((max(distance_m) - min(distance_m)) / 50)) AS step, min(distance_m) AS low FROM options GROUP BY mean) SELECT mean, least(floor((distance_m - low) / step), 49)::INT AS bin, count(*) AS n FROM options JOIN e USING (mean) GROUP BY ALL")
def distance_histogram(spark, d):
    return R.histogram(V.options(spark, d), "mean", "distance_m")


@query("SELECT event_type AS k, min(value) AS low, round(quantile_cont(value, 0.5), 6) AS mid, max(value) AS high, count(value) AS n, arg_min(event_id, {'v': value, 'e': event_id}) FILTER (value IS NOT NULL) AS least_id FROM events GROUP BY 1")
def boxplot_stats(spark, d):
    e = V.read(spark, d, "events")
    least = F.min(F.when(F.col("value").isNotNull(), F.struct("value", "event_id")))["event_id"]
    return e.groupBy(F.col("event_type").alias("k")).agg(F.min("value").alias("low"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("mid"), F.max("value").alias("high"), F.count("value").alias("n"), least.alias("least_id"))


@query(f"""{views("steps")}, r AS (SELECT route AS k, string_agg(flag || status, '>' ORDER BY n) AS signature, sum(quantity) AS q FROM steps GROUP BY 1),
s AS (SELECT signature, count(*) AS n, round(avg(q), 6) AS quantity, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY 1)
SELECT signature, n, quantity, share, row_number() OVER (ORDER BY n DESC, quantity DESC, signature) AS rank FROM s QUALIFY rank <= 10""")
def ranked_signatures(spark, d):
    return R.ranked_signatures(V.steps(spark, d).select(F.col("route").alias("k"), "n", F.concat("flag", "status").alias("part"), F.col("quantity").alias("q")))


@query("SELECT l_orderkey AS k, round(list_reduce([1::DOUBLE] || [x.e FOR x IN list_sort(list({'n': l_linenumber, 'e': 1 - l_tax}))], lambda a, b: a * b), 9) AS efficiency FROM lineitem GROUP BY 1")
def route_product(spark, d):
    r = V.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (1 - F.col("l_tax")).alias("e")))).alias("r"))
    return r.select("k", F.round(F.aggregate("r", F.lit(1.0), lambda a, x: a * x["e"]), 9).alias("efficiency"))


@query(f"{views('branches')} SELECT node, commodity, branch_id, cost FROM branches QUALIFY row_number() OVER (PARTITION BY node, commodity ORDER BY cost, branch_id) = 1")
def dominance_dedupe(spark, d):
    return S.keep_best(V.branches(spark, d), ["node", "commodity"], ["cost", "branch_id"]).select("node", "commodity", "branch_id", "cost")


@query(f"{views('branches')} SELECT start_id, branch_id, cost FROM branches QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY branch_id DESC) = 1")
def upsert_keep_last(spark, d):
    return S.keep_best(V.branches(spark, d), ["start_id"], [F.desc("branch_id")]).select("start_id", "branch_id", "cost")


@query("SELECT c_nationkey AS k, c_custkey AS id, round(sum(q) OVER w - q, 4) AS begins, q FROM (SELECT c_nationkey, c_custkey, round(abs(c_acctbal), 2) AS q, c_custkey % 101 AS cost FROM customer) WINDOW w AS (PARTITION BY c_nationkey ORDER BY cost, c_custkey ROWS UNBOUNDED PRECEDING)")
def supply_curve(spark, d):
    c = V.read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.round(F.abs("c_acctbal"), 2).alias("q"), (F.col("c_custkey") % 101).alias("cost"))
    return R.supply_curve(c, ["k"], "cost", "id", "q").select("k", "id", F.round("begins", 4).alias("begins"), "q")


@query("SELECT c_nationkey AS k, c_custkey AS id, floor((sum(q) OVER w - q) / 20000)::INT AS band FROM (SELECT c_nationkey, c_custkey, round(abs(c_acctbal))::BIGINT AS q FROM customer) WINDOW w AS (PARTITION BY c_nationkey ORDER BY q, c_custkey ROWS UNBOUNDED PRECEDING)")
def threshold_bands(spark, d):
    c = V.read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.round(F.abs("c_acctbal")).cast("long").alias("q"))
    return R.supply_curve(c, ["k"], "q", "id", "q").select("k", "id", F.floor(F.col("begins") / 20000).cast("int").alias("band"))


@query(f"{views('steps')} SELECT route AS k, n, round(total - coalesce(lag(total) OVER (PARTITION BY route ORDER BY n), 0), 6) AS step FROM steps")
def step_cost_lag(spark, d):
    x = F.col("total")
    before = F.lag(x).over(Window.partitionBy("route").orderBy("n"))
    return V.steps(spark, d).select(F.col("route").alias("k"), "n", F.round(x - F.coalesce(before, F.lit(0.0)), 6).alias("step"))


@query(f"{views('branches')} SELECT commodity, branch_id, cost FROM branches QUALIFY row_number() OVER (PARTITION BY commodity ORDER BY cost, branch_id) <= 5")
def topk_per_group(spark, d):
    return S.keep_best(V.branches(spark, d), ["commodity"], ["cost", "branch_id"], 5).select("commodity", "branch_id", "cost")


@query("SELECT k, n, rank() OVER (ORDER BY n DESC) AS place FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1)")
def rank_groups(spark, d):
    g = V.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(_n())
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))))  # one row for each of a few groups


@query(f"{views('steps')} SELECT route AS k, arg_min(node, n) FILTER (flag <> 'N') AS node FROM steps GROUP BY 1")
def first_valid_fallback(spark, d):
    ok = F.when(F.col("flag") != "N", F.struct("n", "node"))
    return V.steps(spark, d).groupBy(F.col("route").alias("k")).agg(F.min(ok)["node"].alias("node"))


@query(f"""{views("steps")}, f AS (SELECT route, n, node AS a, lead(node) OVER (PARTITION BY route ORDER BY n) AS b, quantity * (1 - discount) AS q FROM steps)
SELECT least(a, b) AS a, greatest(a, b) AS b, round(sum(q), 4) AS flow, count(*) AS routes FROM f WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2""")
def weighted_flows(spark, d):
    return R.segment_flows(V.steps(spark, d).select("route", "n", "node", (F.col("quantity") * (1 - F.col("discount"))).alias("q")))


@query("""WITH s AS (SELECT o_custkey AS k, o_orderstatus AS scenario, min(o_totalprice) AS cost FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL)
SELECT k, arg_min(scenario, {'c': cost, 's': scenario}) AS scenario, min(cost) AS cost FROM s GROUP BY k HAVING count(*) = 2""")
def scenario_match(spark, d):
    o = V.read(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    s = o.groupBy(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("scenario")).agg(F.min("o_totalprice").alias("cost"))
    return R.cheapest_scenario(s, 2)


@query(f"""{views("steps")}, s AS (SELECT route AS k, n, total, lag(total, 1, 0) OVER (PARTITION BY route ORDER BY n) AS before, flag FROM steps)
SELECT k, round(sum(CASE WHEN flag = 'A' THEN total - before ELSE 0 END), 4) AS conversion, round(sum(CASE WHEN flag <> 'A' THEN total - before ELSE 0 END), 4) AS transport FROM s GROUP BY k""")
def cost_decomposition(spark, d):
    return R.decompose(V.steps(spark, d).select(F.col("route").alias("k"), "n", "total", (F.col("flag") == "A").alias("is_conversion")))


@query("""WITH i AS (SELECT l_suppkey AS k, l_partkey % 500 AS a, l_partkey % 500 + l_quantity::BIGINT % 6 AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach >= a THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT k, min(a) AS a, max(b) AS b FROM g GROUP BY k, island""")
def merge_intervals(spark, d):
    li = V.read(spark, d, "lineitem")
    a = F.col("l_partkey") % 500
    return R.merge_intervals(li.select(F.col("l_suppkey").alias("k"), a.alias("a"), (a + F.col("l_quantity").cast("long") % 6).alias("b")))


@query("SELECT event_type AS phase, count(*) AS n, max(value) AS most FROM events GROUP BY 1")
def event_stream_summary(spark, d):
    """The batch counterpart of streaming.events.summary."""
    return V.read(spark, d, "events").groupBy(F.col("event_type").alias("phase")).agg(_n(), F.max("value").alias("most"))


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (ORDER BY value DESC, event_id) <= 20")
def largest_events(spark, d):
    e = V.read(spark, d, "events").filter("value is not null")
    return e.orderBy(F.desc("value"), "event_id").limit(20).select("event_id", "event_type", F.round("value", 6).alias("value"))

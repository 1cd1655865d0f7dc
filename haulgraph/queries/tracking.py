"""The telemetry reports, over events in the log's schema."""

from pyspark.sql import functions as F

from haulgraph.plans import tracking as T
from haulgraph.sources import network_view as V

from .registry import query

_LOG = """WITH k AS (SELECT *, (props->>'$.k')::BIGINT AS k FROM events), log AS (SELECT (user_id % 50)::VARCHAR AS location, event_id::DOUBLE AS pos, (event_id % 20)::INT AS iteration, CASE WHEN event_type = 'view' THEN 'iteration' ELSE event_type END AS phase,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'm' || user_id % 4 END AS method, CASE WHEN k % 2 = 0 THEN 'end' ELSE 'step' END AS event, k AS before, k % 50 AS after, k % 7 AS created, k - k % 50 AS removed, value AS runtime_s, k + 0.5::DOUBLE AS benchmark, event_id FROM k)"""


def _log(spark, d):
    e = V.read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k = F.col("k")
    return e.select(
        (F.col("user_id") % 50).cast("string").alias("location"), F.col("event_id").cast("double").alias("time_since_location_start_s"), (F.col("event_id") % 20).cast("int").alias("iteration"),
        F.when(F.col("event_type") == "view", "iteration").otherwise(F.col("event_type")).alias("phase"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("m"), F.col("user_id") % 4)).alias("method"),
        F.when(k % 2 == 0, "end").otherwise("step").alias("event"), k.alias("before"), (k % 50).alias("after"), (k % 7).alias("created"), (k - k % 50).alias("removed"), F.col("value").alias("runtime_s"),
        F.create_map(F.lit("benchmark"), (k + 0.5).cast("string")).alias("details"), "event_id",
    )


@query(f"{_LOG} SELECT location, iteration, runtime_s, before, after, before - after AS removed_in_iteration, NULL::DOUBLE AS benchmark_old, benchmark FROM log WHERE phase = 'iteration' AND event = 'end'")
def tracking_iterations(spark, d):
    return T.iteration_summary(_log(spark, d))


@query(f"{_LOG} SELECT phase, method, event, count(*) AS calls, sum(created)::BIGINT AS total_created, max(created) AS max_created, round(sum(runtime_s), 4) AS total_runtime_s, round(avg(runtime_s), 6) AS mean_runtime_s FROM log WHERE created > 0 GROUP BY 1, 2, 3")
def tracking_creations(spark, d):
    return T.creation_summary(_log(spark, d))


@query(f"{_LOG} SELECT location, event_id, row_number() OVER w AS number, round(sum(runtime_s) OVER w, 4) AS runtime_so_far_s, (sum(removed) OVER w)::BIGINT AS removed_so_far FROM log WINDOW w AS (PARTITION BY location ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING)")
def tracking_chronology(spark, d):
    return T.chronology(_log(spark, d), "event_id").select("location", "event_id", F.col("number").cast("long").alias("number"), F.round("runtime_so_far_s", 4).alias("runtime_so_far_s"), "removed_so_far")


@query(f"{_LOG} SELECT location, count(*) AS events, max(iteration) AS iterations, max(pos) AS duration_s, round(sum(runtime_s), 4) AS runtime_s, sum(created)::BIGINT AS created, sum(removed)::BIGINT AS removed, arg_max(phase, pos) AS last_phase, arg_max(event, pos) AS last_event FROM log GROUP BY 1")
def tracking_locations(spark, d):
    return T.location_summary(_log(spark, d))

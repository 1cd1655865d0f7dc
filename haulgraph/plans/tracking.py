"""Reports on a run's telemetry: rows of the event log's schema (``sources.files.EVENT``) in, one table each out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgraph.operators.prefix import running_sums

from .graphs import Written


def iteration_summary(events: DataFrame) -> DataFrame:
    """The ends of iterations: what each kept and removed, and the benchmark before and after it (null where none was logged)."""
    ends = events.filter("phase = 'iteration' and event = 'end'")
    number = lambda k: F.expr(f"try_cast(details['{k}'] as double)").alias(k)
    return ends.select("location", "iteration", "runtime_s", "before", "after", (F.col("before") - F.col("after")).alias("removed_in_iteration"), number("benchmark_old"), number("benchmark"))


def creation_summary(events: DataFrame) -> DataFrame:
    """What created rows, by phase, method and event; null ones are groups of their own."""
    made = events.filter("created > 0").groupBy("phase", "method", "event")
    return made.agg(F.count(F.lit(1)).alias("calls"), F.sum("created").alias("total_created"), F.max("created").alias("max_created"), F.round(F.sum("runtime_s"), 4).alias("total_runtime_s"), F.round(F.avg("runtime_s"), 6).alias("mean_runtime_s"))


def chronology(events: DataFrame, tie: str, keep: Written | None = None) -> DataFrame:
    """Events with their number in their location's order of time, and the runtime and removals up to each; ``tie`` orders equal times."""
    keep = keep or Written(events.sparkSession)
    timed = events.withColumn("_one", F.lit(1))
    return running_sums(timed, ["location"], ["time_since_location_start_s", tie], {"number": "_one", "runtime_so_far_s": "runtime_s", "removed_so_far": "removed"}, keep).drop("_one")


def location_summary(events: DataFrame) -> DataFrame:
    """Each location's events, iterations, time, and what it created and removed; the reason it ended with is its last event's."""
    last = F.max(F.struct("time_since_location_start_s", "phase", "event"))
    return events.groupBy("location").agg(
        F.count(F.lit(1)).alias("events"), F.max("iteration").alias("iterations"), F.max("time_since_location_start_s").alias("duration_s"), F.round(F.sum("runtime_s"), 4).alias("runtime_s"),
        F.sum("created").alias("created"), F.sum("removed").alias("removed"), last["phase"].alias("last_phase"), last["event"].alias("last_event"),
    )

"""Telemetry reports on a hand-made log."""

from haulgraph.plans import tracking
from haulgraph.sources.files import EVENT

ROWS = [
    ("1", 0.5, 1, "iteration", "a", "start", None, None, None, None, None, None), ("1", 2.0, 1, "iteration", "a", "end", 10, 4, 3, 6, 1.5, {"benchmark": "7.5", "benchmark_old": "inf"}),
    ("1", 2.0, 2, "routing", None, "step", 4, 4, 2, 0, 0.25, {}), ("2", 1.0, 1, "iteration", "a", "end", 5, 5, 0, 0, 1.0, {"benchmark": "none"}), (None, None, None, None, None, None, None, None, None, None, None, None),
]


def log(spark):
    return spark.createDataFrame(ROWS, EVENT)


def test_reports(spark):
    events = log(spark)
    ends = {(r.location, r.iteration): tuple(r)[2:] for r in tracking.iteration_summary(events).collect()}
    assert ends == {("1", 1): (1.5, 10, 4, 6, float("inf"), 7.5), ("2", 1): (1.0, 5, 5, 0, None, None)}
    made = {(r.phase, r.method): (r.calls, r.total_created, r.max_created, r.total_runtime_s) for r in tracking.creation_summary(events).collect()}
    assert made == {("iteration", "a"): (1, 3, 3, 1.5), ("routing", None): (1, 2, 2, 0.25)}
    order = sorted((r.location or "", r.number, r.runtime_so_far_s, r.removed_so_far) for r in tracking.chronology(events, "iteration").collect())
    assert order == [("", 1, 0.0, 0), ("1", 1, 0.0, 0), ("1", 2, 1.5, 6), ("1", 3, 1.75, 6), ("2", 1, 1.0, 0)]
    places = {r.location: (r.events, r.iterations, r.duration_s, r.runtime_s, r.created, r.removed, r.last_phase) for r in tracking.location_summary(events).collect()}
    assert places == {"1": (3, 2, 2.0, 1.75, 5, 6, "routing"), "2": (1, 1, 1.0, 1.0, 0, 0, "iteration"), None: (1, None, None, None, None, None, None)}


def test_reports_of_nothing(spark):
    none = log(spark).limit(0)
    assert all(f(none).collect() == [] for f in (tracking.iteration_summary, tracking.creation_summary, tracking.location_summary)) and tracking.chronology(none, "iteration").collect() == []

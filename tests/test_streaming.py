"""Streaming jobs fed in several batches, one of them twice."""

from pyspark.sql import functions as F

from tidemark.streaming import jobs
from tidemark.streaming.snapshots import shared_folder


def test_changes_over_batches(spark):
    step, baseline, seen = jobs.change_step(shared_folder(spark))
    names = "id long, source_id string, url string, content_hash string, version string"
    batches = [[(1, "s", "u", "a", "1"), (2, "s", "u", "a", "1"), (3, "s", "v", None, "1")], [(4, "s", "u", "b", "1"), (5, "s", "v", None, "1")], [(6, "s", "u", "b", "2")]]
    for k in (0, 1, 1, 2):
        step(spark.createDataFrame(batches[k], names), k)
    got = {r.id: r.kind for r in seen.all_batches(spark).collect()}
    assert got == {1: "new", 2: "unchanged", 3: "new", 4: "changed", 5: "unchanged", 6: "changed"}
    assert {(r.url, r.last_hash, r.version) for r in baseline.latest(spark).collect()} == {("u", "b", "2"), ("v", None, "1")}


def test_events_once(spark):
    step, log = jobs.event_step(shared_folder(spark), F.lit("2026-06-15 12:00:00").cast("timestamp"))
    names = "id long, name string, content string, status_evidence string, registration_phase string, competition_phase string, registration_end timestamp, competition_end timestamp, trust string, official_url string, first_seen timestamp, published string, problem_released boolean"
    row = lambda i, registration, competition, released: (i, "2026 cup", "", "", registration, competition, None, None, "high", "https://a.b/", None, None, released)
    batches = [[row(1, "preview", "unknown", False)] * 2, [row(1, "preview", "unknown", True), row(2, "unknown", "ongoing", None), row(3, "unknown", "unknown", False)]]
    for k in (0, 1, 1):
        step(spark.createDataFrame(batches[k], names), k)
    assert sorted(map(tuple, log.all_batches(spark).collect())) == [(1, "preview_detected"), (1, "problem_released"), (2, "competition_started"), (3, "competition_discovered")]


def test_streaks_over_batches(spark):
    step, state = jobs.streak_step(shared_folder(spark), ["at"])
    names = "source string, failed boolean, at long"
    batches = [[("a", True, 1), ("a", True, 2), ("b", False, 1)], [("a", True, 3), ("b", True, 2)], [("a", False, 4), ("a", True, 5)]]
    for k in (0, 1, 1, 2):
        step(spark.createDataFrame(batches[k], names), k)
    assert sorted(map(tuple, state.latest(spark).select("source", "streak", "total").collect())) == [("a", 1, 5), ("b", 1, 2)]


def test_empty_batch(spark):
    step, state = jobs.streak_step(shared_folder(spark), ["at"])
    step(spark.createDataFrame([], "source string, failed boolean, at long"), 0)
    assert state.latest(spark).where(F.lit(True)).count() == 0

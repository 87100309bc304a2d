"""Dispatch, commit and opting in on small tables."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import dispatch, gates


def now():
    return F.to_timestamp(F.lit("2026-06-15 12:00:00"))


USERS = [(1, "immediate", 0, 0, 0, "UTC"), (2, "daily", 9, 30, 0, "Asia/Shanghai")]
MATCHED = [(1, 7, "preview_detected", "p", 2), (1, 7, "problem_released", "r", 1), (1, 8, "preview_detected", "p", 1), (2, 7, "preview_detected", "p", 1), (3, 7, "preview_detected", "p", 1)]


def told(spark, origin=""):
    users = spark.createDataFrame(USERS, "user_id long, frequency string, hour int, minute int, weekday int, zone string")
    rows = spark.createDataFrame(MATCHED, "user_id long, id long, event_type string, event_key string, place int")
    return dispatch.dispatches(rows, users, now(), origin)


def test_groups_of_dispatches(spark):
    """Immediate groups carry the first event of a user and an entity; users without preferences get nothing."""
    found = {(r.user_id, r.id, r.event_type): (r.due_at, r.delivery_group) for r in told(spark, "backfill:").collect()}
    noon, morning = datetime(2026, 6, 15, 12), datetime(2026, 6, 16, 1, 30)
    at = lambda t: int((t - datetime(1970, 1, 1)).total_seconds())
    assert found == {
        (1, 7, "preview_detected"): (noon, "1:immediate:7:backfill:problem_released:r"),
        (1, 7, "problem_released"): (noon, "1:immediate:7:backfill:problem_released:r"),
        (1, 8, "preview_detected"): (noon, "1:immediate:8:backfill:preview_detected:p"),
        (2, 7, "preview_detected"): (morning, f"2:daily:{at(morning)}"),
    }


def test_commit(spark):
    """Known events aren't dispatched again, held rows stay, repeated events and dispatches count once."""
    events = spark.createDataFrame([(7, "preview_detected", "p"), (7, "preview_detected", "p"), (8, "preview_detected", "p"), (9, "x", "y")], "id long, event_type string, event_key string")
    log = events.where("id = 8")
    held = told(spark).where("user_id = 2").withColumn("status", F.lit("cancelled"))
    rows = told(spark)
    after, outbox = dispatch.commit(log, held, events, rows.unionByName(rows))
    assert sorted(map(tuple, after.collect())) == [(7, "preview_detected", "p"), (8, "preview_detected", "p"), (9, "x", "y")]
    assert sorted((r.user_id, r.id, r.event_type, r.status) for r in outbox.collect()) == [(1, 7, "preview_detected", "pending"), (2, 7, "preview_detected", "cancelled")]
    again, same = dispatch.commit(after, outbox, events, rows)
    assert again.count() == 3 and same.count() == 2


def test_choices_on_what_is_over(spark):
    entities = [(1, "finished", None), (2, "ongoing", "2026-06-14 23:59:59"), (3, "ongoing", "2026-06-15 00:00:00"), (4, None, None)]
    rows = spark.createDataFrame(entities, "id long, competition_phase string, e string").withColumn("competition_end", F.to_timestamp("e"))
    wanted = spark.createDataFrame([(5, i, c) for i in (1, 2, 3, 4, 9) for c in ("participating", "declined")], "user_id long, id long, decision string")
    refused = sorted((r.id, r.decision) for r in dispatch.judge_choices(wanted, rows, now()).where("refused").collect())
    assert refused == [(1, "participating"), (2, "participating")]


def test_audits_go_to_the_latest_snapshot(spark):
    seen = [(1, "s", "u", "h", 5), (2, "s", "u", "h", 9), (3, "s", "u", "h", 9), (4, "s", "u", "i", 9), (5, " ", "u", "h", 1), (6, None, None, None, None)]
    rows = spark.createDataFrame(seen, "id long, source_id string, url string, content_hash string, seen_at long")
    audits = spark.createDataFrame([("s", "u", "h", "a"), (" ", "u", "h", "b"), ("s", "none", "h", "c")], "source_id string, url string, content_hash string, audit string")
    assert {r.id: r.audit for r in dispatch.attach_audits(rows, audits).collect()} == {1: None, 2: None, 3: "a", 4: None, 5: None, 6: None}


def test_age_of_evidence(spark):
    cases = [
        (("第九届", "2025", ""), ("2026-06-01", None), False),
        (("", "大赛2026", "2025"), (None, None), True),
        (("", None, "杯"), ("2026年6月1日", None), True),
        (("", "", ""), ("2025-06-10", "2024-01-01"), True),
        (("", "", ""), ("2025-06-09", "2026-06-01"), False),
        (("", "", ""), ("soon", "2026-07-16"), True),
        (("", "", ""), ("", "2026-07-17"), False),
        (("", "", ""), (None, None), False),
    ]
    rows = spark.createDataFrame([(i, *names, *days) for i, (names, days, _) in enumerate(cases)], "i long, a string, b string, c string, p string, q string")
    midnight = F.to_timestamp(F.lit("2026-06-15 00:00:00"))
    got = rows.select("i", gates.evidence_is_current([F.col(c) for c in "abc"], [F.col("p"), F.col("q")], midnight).alias("ok")).collect()
    assert [r.ok for r in sorted(got)] == [ok for _, _, ok in cases]


def test_tasks_of_a_commit_grow_as_told(spark):
    """Each sort of a commit is over as many tasks as its caller asks for, whatever the session's number."""
    rows = spark.range(50).select(F.pmod("id", F.lit(7)).alias("user_id"), "id", F.concat(F.lit("t"), F.col("id") % 3).alias("event_type"), F.concat(F.lit("k"), F.col("id") % 2).alias("event_key"), F.lit(datetime(2026, 6, 15)).alias("due_at"), F.lit("g").alias("delivery_group"))
    events = rows.select(*dispatch.EVENT)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log, outbox = dispatch.commit(events.where("id < 10"), rows.where("id < 5").withColumn("status", F.lit("sent")), events, rows, tasks=11)
        assert log.count() == 50 and outbox.count() == 45 and outbox.where("status = 'sent'").count() == 5
        for df in (log, outbox):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("hashpartitioning") == len(re.findall(r"hashpartitioning\([^()]*, 11\)", plan)) > 0, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)

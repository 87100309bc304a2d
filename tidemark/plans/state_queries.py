"""Queries of state tables, announcement dates and segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import outbox, records, research
from tidemark.plans.base import query
from tidemark.sources import fixtures as fx

_NOW = f"TIMESTAMP '{fx.NOW}'"
_E, _N, _C = fx.entities_sql(), fx.NOTIFICATIONS_SQL, fx.CHOICES_SQL
_OPEN = "status IN ('pending', 'failed')"


@query(f"""SELECT user_id, competition_id, event_key, status, CASE WHEN {_OPEN} AND s_suppkey IS NOT NULL THEN 'r:' || user_id ELSE delivery_group END AS delivery_group,
CAST(epoch(CASE WHEN {_OPEN} AND s_suppkey IS NOT NULL THEN {_NOW} + INTERVAL 1 DAY ELSE due_at END) AS BIGINT) AS due_at FROM {_N} LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON s_suppkey = user_id""")
def reschedule_open(spark: SparkSession, d: str) -> DataFrame:
    plans = fx.recipients(spark, d).where("enabled").select("user_id", (fx.now() + F.expr("INTERVAL 1 DAY")).alias("due_at"), F.concat(F.lit("r:"), "user_id").alias("delivery_group"))
    return outbox.reschedule(fx.notifications(spark, d), plans).select("user_id", "competition_id", "event_key", "status", "delivery_group", F.unix_timestamp("due_at").alias("due_at"))


@query(f"SELECT user_id, competition_id, event_key, CASE WHEN {_OPEN} AND (user_id, competition_id) IN (SELECT (user_id, competition_id) FROM {_C} WHERE decision = 'declined') THEN 'cancelled' ELSE status END AS status FROM {_N}")
def cancel_declined(spark: SparkSession, d: str) -> DataFrame:
    return outbox.cancel_declined(fx.notifications(spark, d), fx.choices(spark, d)).select("user_id", "competition_id", "event_key", "status")


@query(f"SELECT user_id, competition_id, CASE WHEN competition_id IN (SELECT id FROM {_E} WHERE trust <> 'low') THEN 'declined' ELSE decision END AS decision FROM {_C}")
def decision_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = fx.choices(spark, d)
    return records.decide(old, old.withColumn("decision", F.lit("declined")), fx.entities(spark, d).where("trust <> 'low'"))


@query(f"SELECT user_id, competition_id, event_key FROM {_N} WHERE competition_id NOT IN (SELECT id FROM {_E} WHERE status = 'unknown')")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    return records.cascade(fx.notifications(spark, d), fx.entities(spark, d).where("status = 'unknown'"), "competition_id").select("user_id", "competition_id", "event_key")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'error') WHERE r = 1")
def latest_code(spark: SparkSession, d: str) -> DataFrame:
    codes = fx.table(spark, d, "events").where("event_type <> 'error'").select("user_id", "event_id", "value", "ts")
    return records.latest(codes, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("""SELECT c_custkey AS user_id, coalesce(s, '') AS kinds FROM customer LEFT JOIN (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS s FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id) e ON e.user_id = c_custkey""")
def user_sets(spark: SparkSession, d: str) -> DataFrame:
    child = fx.table(spark, d, "events").select("user_id", "event_type")
    return records.user_sets(fx.audience(spark, d).select("user_id"), child, "kinds", "event_type").select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query(f"""SELECT id, 'competition_end' AS field, CASE WHEN id % 2 = 0 THEN 'unresolved' ELSE 'retryable' END AS status, CAST(CASE WHEN id % 2 = 0 THEN 4 ELSE 3 END AS INTEGER) AS attempts, CAST(epoch(TIMESTAMP '{fx.NOW}' + CASE WHEN id % 2 = 0 THEN INTERVAL 72 HOUR ELSE INTERVAL 0 HOUR END) AS BIGINT) AS next_retry_at FROM {_E} WHERE competition_end IS NULL
UNION ALL SELECT id, 'registration_end', 'resolved', CAST(1 AS INTEGER), CAST(NULL AS BIGINT) FROM {_E} WHERE registration_end IS NULL AND id % 4 <> 0""")
def research_attempts(spark: SparkSession, d: str) -> DataFrame:
    gaps = research.evidence_gaps(fx.entities(spark, d))
    ends = gaps.where("field = 'competition_end'")
    states = ends.select("id", "field", F.lit("retryable").alias("status"), fx.now().alias("next_retry_at"), F.lit(3).alias("attempts"))
    tried = ends.where("id % 2 = 0").select("id", "field", F.lit("unresolved").alias("status"), dates.next_retry(F.lit("unresolved"), fx.now()).alias("next_retry_at"))
    # a resolved attempt with a retry time is against the rules
    wrong = F.when(F.col("id") % 4 == 0, fx.now())
    other = gaps.where("field = 'registration_end'").select("id", "field", F.lit("resolved").alias("status"), wrong.alias("next_retry_at"))
    return records.record_attempts(states, tried.unionByName(other)).select("id", "field", "status", "attempts", F.unix_timestamp("next_retry_at").alias("next_retry_at"))


_P = "(SELECT conv_id, role AS kind, length(text) % 5 <> 0 AS ok, contains(text, 'the') AS flag, length(text) % 101 AS score, CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS place FROM conversations)"


@query(f"""SELECT conv_id, n, ok, CASE WHEN ok = 0 OR ok * 2 < n THEN 'failed' WHEN ok < n THEN 'partial' ELSE 'complete' END AS state, flags * 2 >= ok AS flag, CAST(floor(total / ok) AS BIGINT) AS score, kind
FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (ok) AS ok, count(*) FILTER (ok AND flag) AS flags, sum(score) FILTER (ok) AS total FROM {_P} GROUP BY conv_id)
LEFT JOIN (SELECT conv_id, kind FROM (SELECT conv_id, kind, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, any_value(place)) AS r FROM {_P} WHERE ok GROUP BY conv_id, kind) WHERE r = 1) USING (conv_id)""")
def segment_quorum(spark: SparkSession, d: str) -> DataFrame:
    size = F.char_length("text")
    return records.quorum(fx.table(spark, d, "conversations"), "conv_id", size % 5 != 0, F.contains("text", F.lit("the")), size % 101, F.col("role"), ["assistant", "user"])


@query(f"""SELECT delivery_group, count(*) || ' updates' AS subject, string_agg(competition_id || ': ' || labels, chr(10) ORDER BY competition_id) AS body FROM (
SELECT delivery_group, competition_id, string_agg('e' || event_key, ', ' ORDER BY event_key) AS labels FROM (SELECT DISTINCT delivery_group, competition_id, event_key FROM {_N} WHERE {_OPEN}) GROUP BY ALL) GROUP BY delivery_group""")
def render_deliveries(spark: SparkSession, d: str) -> DataFrame:
    items = fx.notifications(spark, d).where(F.col("status").isin(*outbox.OPEN)).withColumn("label", F.concat(F.lit("e"), "event_key"))
    return outbox.render(items)


@query("""SELECT o_orderkey AS id, CAST(epoch(s) AS BIGINT) AS first_day, CAST(epoch(CASE n WHEN 0 THEN s + INTERVAL 9 DAY WHEN 1 THEN s + INTERVAL 20 DAY WHEN 3 THEN s + INTERVAL 20 DAY END) AS BIGINT) AS last_day
FROM (SELECT o_orderkey, o_orderkey % 4 AS n, date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) + INTERVAL 12000 DAY AS s FROM orders)""")
def registration_dates(spark: SparkSession, d: str) -> DataFrame:
    """None, one, two different and two equal loose deadlines after a range."""
    n, day = F.col("o_orderkey") % 4, lambda k: F.date_format(F.col("_s") + F.make_interval(days=F.lit(k)), "yyyy年M月d日")
    hint = lambda k: F.concat(F.lit("。报名将于今年截止时间为："), day(k))
    more = F.when(n == 0, "").when(n == 1, hint(20)).when(n == 2, F.concat(hint(20), hint(21))).otherwise(F.concat(hint(20), hint(20)))
    rows = fx.table(spark, d, "orders").select("o_orderkey", (F.date_trunc("day", "o_orderdate") + F.expr("INTERVAL 12000 DAY")).alias("_s"))
    said = F.concat(F.lit("报名时间："), day(0), F.lit("至"), day(9), more)
    found = rows.select(F.col("o_orderkey").alias("id"), dates.registration_dates(said).alias("r"))
    return found.select("id", F.unix_timestamp("r.start").alias("first_day"), F.unix_timestamp("r.end").alias("last_day"))


@query()
def text_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "documents").select("doc_id", F.posexplode(text.segments(F.col("text"))).alias("place", "segment"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), "segment")

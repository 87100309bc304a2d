"""Queries of dispatch, commit, choices and attachments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dispatch, match
from tidemark.plans.base import ORACLES, query
from tidemark.sources import announcements as an
from tidemark.sources import fixtures as fx

_KINDS = "[" + ", ".join(f"'{k}'" for k in match.EVENT_FLAGS) + "]"
_M = f"(SELECT l_suppkey AS user_id, l_orderkey AS id, {_KINDS}[CAST(l_linenumber % 6 + 1 AS INTEGER)] AS event_type, 'k' || l_linenumber AS event_key, l_linenumber AS place FROM lineitem)"
_ENTITIES, _CHOICES, _NOTES = an.competitions_sql(), fx.CHOICES_SQL, fx.NOTIFICATIONS_SQL
_OVER = f"(coalesce(competition_phase = 'finished', false) OR coalesce(competition_end < date_trunc('day', TIMESTAMP '{an.NOW}'), false))"


def _matched(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, match.EVENT_FLAGS)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    li = fx.table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("id"), kind.alias("event_type"), F.concat(F.lit("k"), "l_linenumber").alias("event_key"), F.col("l_linenumber").alias("place"))


#: Order lines of one task.
ROWS_A_TASK = 500_000


def _tasks(spark: SparkSession, d: str) -> int:
    """As many tasks as the session has, and more for a large table; the count is read from the file's footer."""
    rows = fx.table(spark, d, "lineitem").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def _dispatches(spark: SparkSession, d: str, tasks: int | None = None) -> DataFrame:
    return dispatch.dispatches(_matched(spark, d), fx.audience(spark, d).withColumn("minute", F.lit(0)), fx.now(), tasks=tasks)


@query(f"""SELECT user_id, id, event_type, event_key, due_at, CASE user_id % 3 WHEN 2 THEN user_id || ':immediate:' || id || ':' || nonce WHEN 0 THEN user_id || ':daily:' || due_at ELSE user_id || ':weekly:' || due_at END AS delivery_group
FROM {_M} JOIN (SELECT user_id, id, arg_min(event_type || ':' || event_key, place) AS nonce FROM {_M} GROUP BY ALL) USING (user_id, id) JOIN ({ORACLES['next_delivery']}) USING (user_id)""")
def event_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return _dispatches(spark, d).withColumn("due_at", F.unix_timestamp("due_at"))


def _committed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # the table has repeated order lines; an outbox holds a key once
    tasks = _tasks(spark, d)
    events, rows = _matched(spark, d).select(*dispatch.EVENT), _dispatches(spark, d, tasks).dropDuplicates(["user_id", *dispatch.EVENT])
    return dispatch.commit(events.where("id % 3 = 0").distinct(), rows.where("user_id % 4 = 0").withColumn("status", F.lit("sent")), events, rows, tasks)


@query(f"SELECT DISTINCT id, event_type, event_key FROM {_M}")
def committed_events(spark: SparkSession, d: str) -> DataFrame:
    return _committed(spark, d)[0]


@query(f"SELECT DISTINCT user_id, id, event_type, event_key, due_at, delivery_group, CASE WHEN user_id % 4 = 0 THEN 'sent' ELSE 'pending' END AS status FROM ({ORACLES['event_dispatch']}) WHERE user_id % 4 = 0 OR id % 3 <> 0")
def committed_outbox(spark: SparkSession, d: str) -> DataFrame:
    return _committed(spark, d)[1].withColumn("due_at", F.unix_timestamp("due_at"))


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    return fx.choices(spark, d).withColumnRenamed("competition_id", "id")


@query(f"SELECT user_id, id, decision, decision = 'participating' AND {_OVER} AS refused FROM {_CHOICES} c JOIN {_ENTITIES} e ON e.id = c.competition_id")
def judged_choices(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.judge_choices(_wanted(spark, d), an.competitions(spark, d), an.now())


@query(f"""SELECT id, event_type, CASE event_type WHEN 'competition_upcoming' THEN 'upcoming' WHEN 'competition_started' THEN 'started' ELSE event_type END AS event_key FROM (
SELECT id, unnest([CASE competition_phase WHEN 'upcoming' THEN 'competition_upcoming' WHEN 'ongoing' THEN 'competition_started' END, CASE WHEN problem_released THEN 'problem_released' END]) AS event_type FROM {_ENTITIES}) WHERE event_type IS NOT NULL""")
def participation_events(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.participation_events(an.competitions(spark, d)).drop("place")


@query(f"SELECT n.user_id, n.competition_id, n.event_key, coalesce(c.decision, 'undecided') AS decision FROM {_NOTES} n LEFT JOIN {_CHOICES} c USING (user_id, competition_id)")
def decision_lookup(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.decisions_of(fx.notifications(spark, d).select("user_id", "competition_id", "event_key"), fx.choices(spark, d))


@query("SELECT url, source AS source_id, doc_id AS id FROM (SELECT *, 'doc/' || (doc_id % 400) AS url FROM documents) WHERE (source, url) NOT IN (SELECT (source, 'doc/' || (doc_id % 400)) FROM documents WHERE doc_id % 5 = 0)")
def forgotten_pages(spark: SparkSession, d: str) -> DataFrame:
    seen = fx.observations(spark, d).select("source_id", "url", "id")
    return dispatch.forget_pages(seen, seen.where("id % 5 = 0"))


_SEEN = f"(SELECT id, 's' AS source_id, url, left(content_hash, 1) AS content_hash, seen_at FROM {fx.OBSERVATIONS_SQL})"


@query(f"""SELECT id, CASE WHEN place = 1 THEN audit END AS audit FROM (SELECT *, row_number() OVER (PARTITION BY url, content_hash ORDER BY seen_at DESC, id DESC) AS place FROM {_SEEN})
LEFT JOIN (SELECT url, content_hash, max(id) AS audit FROM {_SEEN} WHERE id % 3 = 0 GROUP BY ALL) USING (url, content_hash)""")
def analysis_audits(spark: SparkSession, d: str) -> DataFrame:
    seen = fx.observations(spark, d).select("id", F.lit("s").alias("source_id"), "url", F.left("content_hash", F.lit(1)).alias("content_hash"), "seen_at")
    audits = seen.where("id % 3 = 0").groupBy("source_id", "url", "content_hash").agg(F.max("id").alias("audit"))
    blank = audits.withColumn("source_id", F.lit(" ")).limit(1)
    return dispatch.attach_audits(seen, audits.unionByName(blank)).select("id", "audit")


@query(f"SELECT id, CASE WHEN id % 5 = 0 THEN 'new' ELSE trust END AS keywords, CASE WHEN id % 5 = 0 THEN NULL ELSE 'kept' END AS analysis FROM {fx.entities_sql()}")
def enrichment(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.entities(spark, d).select("id", F.col("trust").alias("keywords"), F.lit("kept").alias("analysis"))
    updates = rows.where("id % 5 = 0").select("id", F.lit("new").alias("keywords"), F.lit(None).cast("string").alias("analysis"))
    return dispatch.enrich(rows, updates.unionByName(updates.withColumn("id", -1 - F.col("id"))))


@query("SELECT 'entities' AS name, count(*) AS n FROM orders UNION ALL SELECT 'notifications', count(*) FROM lineitem UNION ALL SELECT 'observations', count(*) FROM documents")
def table_sizes(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.table_sizes({"entities": fx.entities(spark, d), "notifications": fx.notifications(spark, d), "observations": fx.observations(spark, d)})

"""Streaming jobs run over whole tables until nothing is left to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import content_hash
from tidemark.plans.base import query
from tidemark.plans.field_queries import state_sql
from tidemark.sources import announcements as an
from tidemark.sources import fixtures as fx
from tidemark.streaming import jobs
from tidemark.streaming.snapshots import shared_folder


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # a pattern, since a stream takes a plain path for a folder; it names this one table, file or folder
    return spark.readStream.schema(fx.table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query(f"""SELECT id, CASE WHEN p IS NULL THEN 'new' WHEN p = content_hash AND v = version THEN 'unchanged' ELSE 'changed' END AS kind
FROM (SELECT *, lag(content_hash) OVER w AS p, lag(version) OVER w AS v FROM {fx.OBSERVATIONS_SQL} WINDOW w AS (PARTITION BY source_id, url ORDER BY id))""")
def stream_change_detection(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark)
    step, _, seen = jobs.change_step(folder)
    docs = _stream(spark, d, "documents")
    url = F.concat(F.lit("doc/"), F.pmod("doc_id", F.lit(400)))
    jobs.run(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), url.alias("url"), content_hash(F.col("text")).alias("content_hash"), F.col("lang").alias("version")), step, folder)
    return seen.all_batches(spark).select("id", "kind")


@query(f"SELECT DISTINCT id, event_type FROM ({state_sql(an.competitions_sql())})")
def stream_event_log(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark)
    step, log = jobs.event_step(folder, an.now())
    jobs.run(an.entities_of(_stream(spark, d, "orders").select("o_orderkey")), step, folder)
    return log.all_batches(spark)


@query("""SELECT CAST(user_id AS VARCHAR) AS source, count(*) FILTER (event_type = 'error' AND (s IS NULL OR (ts, event_id) > (s.ts, s.event_id))) AS streak, count(*) AS total
FROM events LEFT JOIN (SELECT user_id, max(struct_pack(ts := ts, event_id := event_id)) AS s FROM events WHERE event_type <> 'error' GROUP BY user_id) USING (user_id) GROUP BY user_id""")
def stream_failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark)
    step, state = jobs.streak_step(folder, ["ts", "event_id"])
    results = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), (F.col("event_type") == "error").alias("failed"), "ts", "event_id")
    jobs.run(results, step, folder)
    return state.latest(spark)

"""The polling loops as Structured Streaming jobs.

Each job handles a batch with the set operations of ``tidemark.operators`` and
keeps its state as ``Snapshots``, which survive lost executors and a restarted
driver.  ``run`` reads what is there and stops; a service passes its trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import changes
from tidemark.streaming.snapshots import Snapshots

BASELINE = "source_id string, url string, last_hash string, version string"
SEEN = "id long, source_id string, url string, content_hash string, version string, kind string"
EVENTS = "id long, event_type string"
STREAKS = "source string, streak long, total long"


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], folder: str, **trigger) -> None:
    """Feed every batch of ``stream`` to ``step``; progress is kept under ``folder``."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress")
    writer.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


def change_step(folder: str) -> tuple[Callable[[DataFrame, int], None], Snapshots, Snapshots]:
    """Change detection of observations (id, source_id, url, content_hash, version), ordered by id.

    An observation is compared with the one before it of its key in the batch,
    else with the baseline.  Gives the step, the baseline and the judged rows.
    """
    baseline, seen = Snapshots(f"{folder}/baseline", BASELINE), Snapshots(f"{folder}/seen", SEEN)
    key = ["source_id", "url"]

    def step(rows: DataFrame, batch: int) -> None:
        known = baseline.version(rows.sparkSession, batch - 1)
        order = Window.partitionBy(*key).orderBy("id")
        before = rows.withColumn("_before", F.lag(F.struct("content_hash", "version")).over(order))
        first = changes.detect_changes(before.where("_before is null"), known)
        same = F.col("_before.content_hash").eqNullSafe(F.col("content_hash")) & F.col("_before.version").eqNullSafe(F.col("version"))
        later = before.where("_before is not null").withColumn("kind", F.when(same, "unchanged").otherwise("changed"))
        judged = first.unionByName(later).select("id", *key, "content_hash", "version", "kind")
        seen.write(judged, batch)
        last = seen.version(rows.sparkSession, batch).groupBy(*key).agg(F.max_by(F.struct("content_hash", "version"), "id").alias("_last"))
        baseline.write(changes.next_baseline(last.select(*key, "_last.*"), known), batch)

    return step, baseline, seen


def event_step(folder: str, now: Column) -> tuple[Callable[[DataFrame, int], None], Snapshots]:
    """Events that the states of entities imply at ``now``, each written once for ever.

    The log only grows: its keys never expire, so it is a table and not stream state.
    """
    log = Snapshots(f"{folder}/log", EVENTS)

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        events = changes.state_events(rows, now).distinct()
        if batch:
            events = changes.unrecorded(events, log.all_batches(spark, batch))
        log.write(events, batch)

    return step, log


def streak_step(folder: str, order: list[str]) -> tuple[Callable[[DataFrame, int], None], Snapshots]:
    """The current failures in a row of each source, from results (source, failed, *order).

    A batch adds its failures after its last success, and the streak before it
    if it had none; both are plain aggregates, combined before the shuffle.
    """
    state = Snapshots(f"{folder}/streaks", STREAKS)

    def step(rows: DataFrame, batch: int) -> None:
        place = F.struct(*order)
        last = rows.where("not failed").groupBy("source").agg(F.max(place).alias("_success"))
        after = rows.select("source", "failed", place.alias("_place")).join(last, "source", "left")
        counted = after.groupBy("source").agg(
            F.count_if(F.col("failed") & (F.col("_success").isNull() | (F.col("_place") > F.col("_success")))).alias("_new"),
            F.bool_or(F.col("_success").isNotNull()).alias("_reset"),
            F.count("*").alias("_rows"),
        )
        both = state.version(rows.sparkSession, batch - 1).join(counted, "source", "full")
        none = F.lit(0)
        kept = F.when(F.coalesce("_reset", F.lit(False)), none).otherwise(F.coalesce("streak", none))
        state.write(both.select("source", (kept + F.coalesce("_new", none)).alias("streak"), (F.coalesce("total", none) + F.coalesce("_rows", none)).alias("total")), batch)

    return step, state

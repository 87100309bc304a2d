"""From events to outbox rows: dispatch, commit, opting in, and what is attached to pages and entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import next_delivery
from tidemark.operators.changes import COMPETITION_EVENTS, RELEASED
from tidemark.operators.gates import ended
from tidemark.operators.outbox import group_key
from tidemark.operators.records import first_by, latest

EVENT = ["id", "event_type", "event_key"]
PAGE = ["source_id", "url"]
PARTICIPATION_KEYS = {"competition_upcoming": "upcoming", "competition_started": "started", RELEASED: "problem_released"}


def dealt(df: DataFrame, tasks: int | None, *key: str) -> DataFrame:
    """``df`` shuffled by ``key`` into so many tasks, if a number is given."""
    return df.repartition(tasks, *key) if tasks else df


def dispatches(matched: DataFrame, users: DataFrame, now: Column, origin: str = "", tasks: int | None = None) -> DataFrame:
    """``matched`` (user_id, id, event_type, event_key, place) with ``due_at`` and ``delivery_group``.

    Immediate groups are named after ``origin`` and the event of the smallest
    ``place`` that the user is told of this entity; a user and an entity have no
    more events than there are kinds, so their window is short.  ``users`` has the
    delivery preferences; their zones must be valid.  ``tasks`` should grow with
    ``matched``, so that what a task sorts doesn't.
    """
    own = users.select("user_id", "frequency", "hour", "minute", "weekday", "zone")
    head = F.min(F.struct("place", "event_type", "event_key")).over(Window.partitionBy("user_id", "id"))
    met = dealt(dealt(matched, tasks, "user_id", "id").withColumn("_first", head), tasks, "user_id").join(own, "user_id")
    due = next_delivery(now, *(F.col(c) for c in ("frequency", "hour", "minute", "weekday", "zone")))
    nonce = F.concat(F.lit(origin), "_first.event_type", F.lit(":"), "_first.event_key")
    timed = met.withColumn("due_at", due)
    return timed.select("user_id", *EVENT, "due_at", group_key(F.col("user_id"), F.col("id"), F.col("frequency"), F.col("due_at"), nonce).alias("delivery_group"))


def commit(log: DataFrame, outbox: DataFrame, events: DataFrame, rows: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The log and the outbox after ``events`` and their dispatches ``rows``.

    Only events that the log didn't hold are dispatched, and a row that the
    outbox holds stays as it is.  Both results read the same two tables, so they
    are to be written as one version.  ``tasks`` as in ``dispatches``.
    """
    key = ["user_id", *EVENT]
    fresh = dealt(events.select(*EVENT), tasks, *EVENT).dropDuplicates().join(dealt(log, tasks, *EVENT), EVENT, "left_anti")
    told = dealt(rows.select(*key, "due_at", "delivery_group"), tasks, *EVENT).join(fresh, EVENT, "left_semi")
    new = dealt(first_by(told, key, ["due_at", "delivery_group"]), tasks, *key).join(dealt(outbox, tasks, *key), key, "left_anti").withColumn("status", F.lit("pending"))
    return log.unionByName(fresh.select(*log.columns)), outbox.unionByName(new.select(*outbox.columns))


def judge_choices(wanted: DataFrame, entities: DataFrame, now: Column) -> DataFrame:
    """``wanted`` (user_id, id, decision) on known entities with ``refused``: one can't take part in what is over."""
    state = entities.select("id", F.coalesce(ended(now), F.lit(False)).alias("_over"))
    return wanted.join(state, "id").withColumn("refused", (F.col("decision") == "participating") & F.col("_over")).drop("_over")


def participation_events(entities: DataFrame) -> DataFrame:
    """Rows (id, event_type, event_key, place): what one who begins to take part is told at once."""
    told = [F.when(F.col("competition_phase") == phase, event) for phase, event in COMPETITION_EVENTS.items()]
    told.append(F.when(F.col("problem_released"), RELEASED))
    rows = entities.select("id", F.explode(F.array_compact(F.array(*told))).alias("event_type"))
    names = list(PARTICIPATION_KEYS)
    keys = F.create_map(*(F.lit(x) for pair in PARTICIPATION_KEYS.items() for x in pair))
    return rows.select("id", "event_type", keys[F.col("event_type")].alias("event_key"), F.array_position(F.array(*map(F.lit, names)), F.col("event_type")).alias("place"))


def decisions_of(pairs: DataFrame, choices: DataFrame) -> DataFrame:
    """``pairs`` (user_id, competition_id) with ``decision``, 'undecided' where there is none."""
    met = pairs.join(choices.select("user_id", "competition_id", "decision"), ["user_id", "competition_id"], "left")
    return met.withColumn("decision", F.coalesce("decision", F.lit("undecided")))


def forget_pages(baseline: DataFrame, pages: DataFrame) -> DataFrame:
    """``baseline`` without ``pages``, so that the next scan takes them for new."""
    return baseline.join(pages.select(*PAGE), PAGE, "left_anti")


def attach_audits(observations: DataFrame, audits: DataFrame) -> DataFrame:
    """``observations`` with the ``audit`` of (source_id, url, content_hash) on the latest snapshot of each.

    Keys are unique in ``audits``; those with a blank part are left out.  The
    latest snapshot is found by an aggregate, so a page that is seen very often
    is combined before the shuffle.
    """
    key = [*PAGE, "content_hash"]
    named = audits.where(reduce(lambda a, b: a & b, (F.trim(c) != "" for c in key))).select(*key, "audit")
    last = latest(observations.select(*key, "seen_at", "id"), key, ["seen_at", "id"]).select(*key, "id")
    return observations.join(last.join(named, key).select("id", "audit"), "id", "left")


def enrich(entities: DataFrame, updates: DataFrame) -> DataFrame:
    """``entities`` with ``keywords`` and ``analysis`` of ``updates`` (id, keywords, analysis), whose ids are unique; unknown ones change nothing."""
    new = updates.select("id", F.struct("keywords", "analysis").alias("_new"))
    met = entities.join(new, "id", "left")
    return met.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("keywords", "analysis")}).drop("_new")


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (name, n) of several tables."""
    sizes = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, sizes)

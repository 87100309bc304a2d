"""Delivery outbox: grouping, enqueueing, due groups, marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import backoff_seconds
from tidemark.operators.match import LISTS, deliverable, event_enabled, fits_user, with_forms

OPEN = ("pending", "failed")
KEY = ["user_id", "competition_id", "event_key"]


def group_key(user: Column, competition: Column, frequency: Column, due: Column, nonce: Column) -> Column:
    """One group for each user and due time; immediate ones by competition and nonce."""
    batch = F.format_string("%d:%s:%d", user.cast("long"), frequency, F.unix_timestamp(due))
    single = F.format_string("%d:immediate:%d:%s", user.cast("long"), competition.cast("long"), nonce)
    return F.when(frequency == "immediate", single).otherwise(batch)


def due_groups(notifications: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Rows (delivery_group, user_id, due_at) with an open row that is due, of enabled users."""
    open_rows = notifications.where(F.col("status").isin(*OPEN) & (F.col("due_at") <= now))
    enabled = users.where("enabled").select("user_id")
    return open_rows.join(enabled, "user_id").groupBy("delivery_group", "user_id").agg(F.min("due_at").alias("due_at"))


def group_items(notifications: DataFrame, groups: DataFrame, choices: DataFrame) -> DataFrame:
    """All open rows of the groups, due or not, with the user's decision."""
    rows = notifications.where(F.col("status").isin(*OPEN)).join(groups.select("delivery_group", "user_id"), ["delivery_group", "user_id"], "left_semi")
    met = rows.join(choices.select("user_id", "competition_id", "decision"), ["user_id", "competition_id"], "left")
    return met.withColumn("decision", F.coalesce("decision", F.lit("undecided")))


def pending_counts(notifications: DataFrame) -> DataFrame:
    return notifications.where(F.col("status").isin(*OPEN)).groupBy("user_id").agg(F.count("*").alias("n"))


def enqueue(outbox: DataFrame, dispatches: DataFrame) -> DataFrame:
    """The outbox after dispatches: new keys are pending, only cancelled rows are revived."""
    fresh = dispatches.select(*KEY, F.col("due_at").alias("_due"), F.col("delivery_group").alias("_group"), F.lit(True).alias("_fresh"))
    both = outbox.join(fresh, KEY, "full")
    taken = F.col("_fresh").isNotNull() & (F.col("status").isNull() | (F.col("status") == "cancelled"))
    return both.select(
        *KEY,
        F.when(taken, "pending").otherwise(F.col("status")).alias("status"),
        F.when(taken, F.col("_due")).otherwise(F.col("due_at")).alias("due_at"),
        F.when(taken, F.col("_group")).otherwise(F.col("delivery_group")).alias("delivery_group"),
        F.when(taken, 0).otherwise(F.col("attempt_count")).alias("attempt_count"),
    )


def mark_failed(outbox: DataFrame, groups: DataFrame, now: Column) -> DataFrame:
    """Rows of failed groups: one attempt more, due again after the backoff."""
    failed = groups.select("delivery_group").distinct().withColumn("_failed", F.lit(True))
    both = outbox.join(failed, "delivery_group", "left")
    hit = F.col("_failed").isNotNull()
    again = F.timestamp_seconds(F.unix_timestamp(now) + backoff_seconds(F.col("attempt_count")))
    return both.withColumns(
        {"status": F.when(hit, "failed").otherwise(F.col("status")), "due_at": F.when(hit, again).otherwise(F.col("due_at")), "attempt_count": F.col("attempt_count") + hit.cast("int")}
    ).drop("_failed")


def mark_sent(outbox: DataFrame, groups: DataFrame) -> DataFrame:
    sent = groups.select("delivery_group").distinct().withColumn("_sent", F.lit(True))
    return outbox.join(sent, "delivery_group", "left").withColumn("status", F.when(F.col("_sent").isNotNull(), "sent").otherwise(F.col("status"))).drop("_sent")


def cancel(outbox: DataFrame, items: DataFrame) -> DataFrame:
    """Open rows with the keys of ``items`` become cancelled."""
    gone = items.select(*KEY).distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone").isNotNull() & F.col("status").isin(*OPEN)
    return outbox.join(gone, KEY, "left").withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).drop("_gone")


def history(notifications: DataFrame, competitions: DataFrame, user: int, most: int = 20) -> DataFrame:
    """A user's newest notifications with the entity's status."""
    most = most if 1 <= most <= 100 else 20
    own = notifications.where(F.col("user_id") == user).join(competitions.select(F.col("id").alias("competition_id"), F.col("status").alias("entity_status")), "competition_id")
    return own.orderBy(F.desc("due_at"), "competition_id", "event_key").limit(most)


def reschedule(outbox: DataFrame, plans: DataFrame) -> DataFrame:
    """Open rows of the users in ``plans`` (user_id, due_at, delivery_group) move to that time and group."""
    plan = plans.select("user_id", F.col("due_at").alias("_due"), F.col("delivery_group").alias("_group"))
    hit = F.col("_group").isNotNull() & F.col("status").isin(*OPEN)
    moved = {"due_at": F.when(hit, F.col("_due")).otherwise(F.col("due_at")), "delivery_group": F.when(hit, F.col("_group")).otherwise(F.col("delivery_group"))}
    return outbox.join(plan, "user_id", "left").withColumns(moved).drop("_due", "_group")


def cancel_declined(outbox: DataFrame, choices: DataFrame) -> DataFrame:
    """Open rows about what their user has declined become cancelled."""
    pair = ["user_id", "competition_id"]
    declined = choices.where("decision = 'declined'").select(*pair).distinct().withColumn("_declined", F.lit(True))
    hit = F.col("_declined").isNotNull() & F.col("status").isin(*OPEN)
    return outbox.join(declined, pair, "left").withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).drop("_declined")


def render(items: DataFrame) -> DataFrame:
    """One message for each delivery group of ``items`` (delivery_group, competition_id, event_key, label).

    A line names an entity and its labels in order of the event keys; the
    subject counts the entities.  A group holds what one user is told at once.
    """
    labels = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("event_key", "label"))), lambda x: x["label"]), ", ")
    lines = items.groupBy("delivery_group", "competition_id").agg(labels.alias("labels"))
    line = F.struct("competition_id", F.format_string("%d: %s", "competition_id", "labels").alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "\n")
    return lines.groupBy("delivery_group").agg(F.format_string("%d updates", F.count("*")).alias("subject"), body.alias("body"))


def revalidate(queue: DataFrame, users: DataFrame, entities: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """``queue`` (user_id, id, event_type, ...) with ``valid``: whether an item still fits its user as things stand.

    What doesn't is to be cancelled, not sent.  Each item meets its own user and
    entity only, so the work is in proportion to the queue.  What the state of the
    entity rules out by itself doesn't carry the entity on to its user, so only the
    items that are left are moved with all that is compared.
    """
    state = ("registration_phase", "competition_phase", "registration_end", "competition_end", "problem_released")
    chosen = decisions.select("user_id", F.col("competition_id").alias("id"), "decision")
    users = with_forms(users)
    prefs = users.select(F.lit(True).alias("_open"), "user_id", F.struct(*(c for c in users.columns if c != "user_id")).alias("_u"))
    seen = ("eligible", "search_text", "trust", "eligibility_note", *LISTS)
    rows = entities.select("id", F.struct(*state, *seen).alias("_e"))
    met = queue.join(chosen, ["user_id", "id"], "left").join(rows, "id", "left")
    still = F.coalesce(deliverable(F.col("event_type"), F.coalesce("decision", F.lit("undecided")), *(F.col(f"_e.{c}") for c in state), now), F.lit(False))
    # the flag is a part of the key: what is ruled out meets no user, and is dealt over all tasks
    left = met.withColumn("_open", still).select(*queue.columns, "_open", F.when(F.col("_open"), F.struct(*(F.col(f"_e.{c}").alias(c) for c in seen))).alias("_e"))
    both = left.join(prefs, ["_open", "user_id"], "left")
    ok = F.col("_open") & event_enabled(F.col("event_type"), lambda c: F.col(f"_u.{c}")) & fits_user(lambda c: F.col(f"_u.{c}"), lambda c: F.col(f"_e.{c}"))
    return both.select(*queue.columns, F.coalesce(ok, F.lit(False)).alias("valid"))

"""Small tables of users, decisions and attempts: upserts, cascades and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those of equal keys; keys are unique in ``rows``."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*table.columns))


def decide(choices: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """Decisions (user_id, competition_id, decision) after ``new``; those on unknown entities are ignored."""
    known = new.join(entities.select(F.col("id").alias("competition_id")), "competition_id", "left_semi")
    return upsert(choices, known, ["user_id", "competition_id"])


def cascade(children: DataFrame, removed: DataFrame, parent: str) -> DataFrame:
    """``children`` without those of removed entities (id)."""
    return children.join(removed.select(F.col("id").alias(parent)), parent, "left_anti")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; an aggregate, so rows are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*key, *(F.col(f"_last.{c}").alias(c) for c in rest))


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*key, *(F.col(f"_first.{c}").alias(c) for c in rest))


def record_attempts(states: DataFrame, attempts: DataFrame) -> DataFrame:
    """Research states after attempts (id, field, status, next_retry_at).

    Retryable and unresolved attempts need a retry time, others must have none;
    attempts that break this are ignored.  The count of a known state grows by 1.
    """
    wants = F.col("status").isin("retryable", "unresolved")
    ok = attempts.where(wants == F.col("next_retry_at").isNotNull())
    new = ok.select("id", "field", F.col("status").alias("_status"), F.col("next_retry_at").alias("_next"), F.lit(True).alias("_new"))
    both = states.join(new, ["id", "field"], "full")
    hit = F.col("_new").isNotNull()
    return both.select(
        "id",
        "field",
        F.when(hit, F.col("_status")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.col("_next")).otherwise(F.col("next_retry_at")).alias("next_retry_at"),
        (F.coalesce("attempts", F.lit(0)) + hit.cast("int")).alias("attempts"),
    )


def user_sets(users: DataFrame, child: DataFrame, name: str, value: str) -> DataFrame:
    """``users`` with the sorted set of a child table's values, empty where there are none."""
    sets = child.groupBy("user_id").agg(F.array_sort(F.collect_set(value)).alias(name))
    return users.join(sets, "user_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def quorum(parts: DataFrame, key: str, ok: Column, flag: Column, score: Column, kind: Column, priority: list[str]) -> DataFrame:
    """Segment results as one of each document.

    Half of the segments must have succeeded, else the row is ``failed``; a flag
    needs half of the successes, scores are averaged and cut to whole numbers,
    and the commonest kind wins, ties by ``priority``.
    """
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), kind), F.lit(0)), F.lit(len(priority) + 1))
    votes = parts.groupBy(key, kind.alias("kind"), place.alias("_place")).agg(
        F.count("*").alias("_n"), F.count_if(ok).alias("_ok"), F.count_if(ok & flag).alias("_flag"), F.sum(F.when(ok, score)).alias("_score")
    )
    best = F.max_by(F.when(F.col("_ok") > 0, F.col("kind")), F.struct("_ok", -F.col("_place")))
    merged = votes.groupBy(key).agg(F.sum("_n").alias("n"), F.sum("_ok").alias("ok"), F.sum("_flag").alias("_f"), F.sum("_score").alias("_s"), best.alias("kind"))
    state = F.when((F.col("ok") == 0) | (F.col("ok") * 2 < F.col("n")), "failed").when(F.col("ok") < F.col("n"), "partial").otherwise("complete")
    return merged.select(key, "n", "ok", state.alias("state"), (F.col("_f") * 2 >= F.col("ok")).alias("flag"), F.floor(F.try_divide(F.col("_s"), F.col("ok"))).alias("score"), "kind")

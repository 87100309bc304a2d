"""Snapshots: latest, first seen, what to keep and what to compact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.outbox import OPEN


def latest_observation(observations: DataFrame, keys: tuple[str, ...] = ("source_id", "url", "content_hash")) -> DataFrame:
    """The newest snapshot of each key: by time, then id."""
    rest = [c for c in observations.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("seen_at", "id"))
    return observations.groupBy(*keys).agg(newest.alias("s")).select(*keys, "s.*")


def first_observed(observations: DataFrame) -> DataFrame:
    return observations.groupBy("url").agg(F.min("seen_at").alias("first_seen"))


def kept_observations(observations: DataFrame, before: Column) -> DataFrame:
    """Without old snapshots, except the newest of each source and URL."""
    newest = observations.groupBy("source_id", "url").agg(F.max("id").alias("id")).select("id")
    recent = observations.where(F.col("seen_at") >= before)
    old = observations.where(F.col("seen_at") < before).join(newest, "id", "left_semi")
    return recent.unionByName(old.select(*recent.columns))


def compactable(competitions: DataFrame, notifications: DataFrame, before: Column) -> DataFrame:
    """Closed or finished entities unseen since ``before`` without an open notification."""
    done = competitions.where(F.col("status").isin("registration_closed", "finished") & (F.col("last_seen") < before))
    waiting = notifications.where(F.col("status").isin(*OPEN)).select(F.col("competition_id").alias("id"))
    return done.join(waiting, "id", "left_anti")

"""Lists for the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lifecycle import dashboard_rank


def actionable_list(entities: DataFrame, now: Column, most: int = 20) -> DataFrame:
    """What one can still act on: open first, then upcoming, then preview; newest first."""
    most = most if 1 <= most <= 100 else 20
    status, end = F.col("status"), F.col("registration_end")
    live = status.isin("preview", "registration_open", "upcoming", "ongoing") & (F.col("competition_end").isNull() | (F.col("competition_end") >= now))
    open_ = status.isin("upcoming", "ongoing") | end.isNull() | (end >= now)
    return entities.where(live & open_).orderBy(dashboard_rank(status), F.desc("last_seen"), "id").limit(most)


def unconfirmed_list(entities: DataFrame, most: int = 20) -> DataFrame:
    return entities.where("status = 'unknown'").orderBy(F.desc("last_seen"), "id").limit(most if 1 <= most <= 100 else 20)


def active(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("status").isin("preview", "registration_open", "registration_closed", "upcoming", "ongoing"))


def is_actionable(status: Column, registration_end: Column, competition_end: Column, year: Column, now: Column) -> Column:
    """Phase, ends and year of an entity allow acting on it."""
    phase = status.isin("preview", "registration_open", "upcoming", "ongoing")
    ended = F.coalesce(competition_end < now, F.lit(False))
    late = (status == "registration_open") & F.coalesce(registration_end < now, F.lit(False))
    return phase & ~ended & ~late & ((year == 0) | (year >= F.year(now)))

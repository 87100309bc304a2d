"""Evidence gaps and the budgeted plan to fill them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lifecycle import DATE_FIELDS


def evidence_gaps(entities: DataFrame) -> DataFrame:
    """Rows (id, pos, field): the missing dates of each entity in fixed order."""
    missing = F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in DATE_FIELDS))
    return entities.select("id", F.posexplode(missing).alias("pos", "field")).where("field is not null")


def research_plan(gaps: DataFrame, states: DataFrame, now: Column, budget: int) -> DataFrame:
    """Rows (id, field) that are due, of the first ``budget`` entities.

    Never researched entities come first, then smaller ids.
    """
    due = gaps.join(states.select("id", "field", "next_retry_at", F.lit(True).alias("_known")), ["id", "field"], "left").where(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    known = states.select("id").distinct().withColumn("_seen", F.lit(True))
    entities = due.select("id").distinct().join(known, "id", "left").orderBy(F.col("_seen").isNotNull(), "id").limit(budget)
    return due.join(entities.select("id"), "id", "left_semi").select("id", "field")

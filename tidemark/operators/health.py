"""Failure streaks of sources and the alerts that they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failure_streaks(log: DataFrame, source: str, order: list[str], failed: str, span: Column) -> DataFrame:
    """``log`` with ``streak``: failures in a row up to each entry; a success is 0.

    ``span`` cuts the log into ranges that follow ``order`` (days, say).  Each
    range is first summed up in one row, a window over these short rows carries
    streaks from range to range, and entries are ranked inside their range only,
    so no task gets the whole log of a source.
    """
    rows = log.withColumn("_span", span)
    place = F.struct(*order)
    last = rows.where(~F.col(failed)).groupBy(source, "_span").agg(F.max(place).alias("_success"))
    keyed = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (source, "_span")]
    after = rows.alias("a").join(last.alias("b"), keyed[0] & keyed[1], "left").select(*(F.col(f"a.{c}").alias(c) for c in (source, "_span", failed)), place_of("a", order).alias("_place"), "b._success")
    trailing = F.count_if(F.col(failed) & (F.col("_success").isNull() | (F.col("_place") > F.col("_success"))))
    spans = after.groupBy(source, "_span").agg(trailing.alias("_trailing"), F.bool_or(F.col("_success").isNotNull()).alias("_reset"))
    through = Window.partitionBy(source).orderBy("_span")
    islands = spans.withColumn("_no", F.sum(F.col("_reset").cast("int")).over(through.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(source, "_no").orderBy("_span").rowsBetween(Window.unboundedPreceding, 0)
    carried = islands.withColumn("_after", F.sum("_trailing").over(within)).withColumn("_carry", F.coalesce(F.lag("_after").over(through), F.lit(0)))
    carry = carried.select(source, "_span", "_carry")

    inside = Window.partitionBy(source, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_island", F.sum((~F.col(failed)).cast("int")).over(inside))
    island = Window.partitionBy(source, "_span", "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_own", F.sum(F.col(failed).cast("int")).over(island))
    met = ranked.alias("a").join(carry.alias("b"), keyed[0] & keyed[1], "left")
    streak = F.when(F.col(f"a.{failed}"), F.col("_own") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)).otherwise(0)
    return met.select(*(F.col(f"a.{c}").alias(c) for c in log.columns), streak.alias("streak"))


def place_of(alias: str, order: list[str]) -> Column:
    return F.struct(*(F.col(f"{alias}.{c}") for c in order))


def alerts(streaks: DataFrame, source: str, order: list[str], least: int, once: bool = False, alerted: DataFrame | None = None) -> DataFrame:
    """Entries that raise an alert: the streak is long enough.

    A growing outage alerts again at every entry; ``once`` gives one for each
    outage.  With ``alerted`` (the source, ``streak``: the count last told of and not
    yet recovered from), an entry must also be longer than that; a success in
    ``streaks`` forgets it for what follows.
    """
    due = F.col("streak") == least if once else F.col("streak") >= least
    if alerted is None:
        return streaks.where(due)
    recovered = streaks.where("streak = 0").groupBy(F.col(source).alias("_of")).agg(F.min(F.struct(*order)).alias("_recovered"))
    told = alerted.select(F.col(source).alias("_told_of"), F.col("streak").alias("_told"))
    met = streaks.join(recovered, F.col(source).eqNullSafe(F.col("_of")), "left").join(told, F.col(source).eqNullSafe(F.col("_told_of")), "left")
    fresh = F.col("_told").isNull() | (F.struct(*order) > F.col("_recovered")) | (F.col("streak") > F.col("_told"))
    return met.where(due & F.coalesce(fresh, F.lit(False))).select(*streaks.columns)


def alerted_counts(streaks: DataFrame, source: str, order: list[str], least: int, alerted: DataFrame | None = None) -> DataFrame:
    """Rows (source, streak) for the next run: the last alerted count of outages that still go on."""
    last = streaks.groupBy(source).agg(F.max_by("streak", F.struct(*order)).alias("streak"))
    now = last.where(F.col("streak") >= least)
    if alerted is None:
        return now
    return now.unionByName(alerted.select(source, "streak").join(last.select(source), source, "left_anti"))

"""Statuses, phases, trust and their orders."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of the orders.
TRUST = {"low": 1, "medium": 2, "high": 3}
STATUS = {"unknown": 0, "preview": 10, "registration_open": 20, "registration_closed": 30, "upcoming": 40, "ongoing": 50, "finished": 60}
DATE_FIELDS = ("registration_start", "registration_end", "competition_start", "competition_end")


def rank(c: Column, order: dict[str, int], default: int) -> Column:
    table = F.create_map(*map(F.lit, chain.from_iterable(order.items())))
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def trust_rank(c: Column) -> Column:
    return rank(c, TRUST, 1)


def composite_status(registration: Column, competition: Column) -> Column:
    """One status of two phases; the competition phase comes first."""
    return (
        F.when(competition.isin("upcoming", "ongoing", "finished"), competition)
        .when(registration == "open", "registration_open")
        .when(registration == "closed", "registration_closed")
        .when(registration == "preview", "preview")
        .otherwise("unknown")
    )


def phases(status: Column) -> Column:
    """Struct (registration, competition) of a status."""
    registration = F.when(status == "registration_open", "open").when(status == "registration_closed", "closed").when(status == "preview", "preview").otherwise("unknown")
    competition = F.when(status.isin("upcoming", "ongoing", "finished"), status).otherwise("unknown")
    return F.struct(registration.alias("registration"), competition.alias("competition"))


def dashboard_rank(status: Column) -> Column:
    return F.when(status == "registration_open", 0).when(status == "upcoming", 1).when(status == "preview", 2).otherwise(3)


def fact_confidence(trust: Column, evidence: Column, edition: Column, published: Column) -> Column:
    """Confidence of a fact from its source's trust and what backs it."""
    present = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    score = (
        F.when(trust == "high", 3).when(trust == "medium", 2).otherwise(0)
        + F.when(F.char_length(F.trim(F.coalesce(evidence, F.lit("")))) >= 8, 2).otherwise(0)
        + present(edition).cast("int")
        + present(published).cast("int")
    )
    high = F.when(score >= 6, "high").when(score >= 4, "medium").otherwise("low")
    medium = F.when(score >= 4, "medium").otherwise("low")
    return F.when(trust == "high", high).when(trust == "medium", medium).otherwise("low")

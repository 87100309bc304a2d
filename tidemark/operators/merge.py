"""Merging two observations of an entity: trust decides conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lifecycle import STATUS, rank, trust_rank
from tidemark.functions.markers import TITLE_NOISE
from tidemark.functions.text import contains_any, distinct_ignoring_case
from tidemark.operators.pages import normalized
from tidemark.operators.upsert import DATES, ENTITY, STATED, complete


def merge_facts(old: Column, new: Column, prefer_new: Column | bool) -> Column:
    """Union of two fact maps; on shared keys the new one wins only if preferred."""
    none = lambda m: F.coalesce(m, F.create_map().cast(ENTITY["facts"]))
    prefer = prefer_new if isinstance(prefer_new, Column) else F.lit(prefer_new)
    return F.map_zip_with(none(old), none(new), lambda _, a, b: F.when(prefer, F.coalesce(b, a)).otherwise(F.coalesce(a, b)))


def union_keywords(old: Column, new: Column) -> Column:
    """Trimmed, without blanks; the first of each spelling."""
    none = F.array().cast("array<string>")
    words = F.transform(F.concat(F.coalesce(old, none), F.coalesce(new, none)), lambda w: F.trim(w))
    return distinct_ignoring_case(F.filter(words, lambda w: F.coalesce(w != "", F.lit(False))))


def old_name_stays(old: Column, new: Column) -> Column:
    """Without noise before with, then the shorter, then the old one."""
    a, b = contains_any(old, TITLE_NOISE), contains_any(new, TITLE_NOISE)
    return F.when(a != b, ~a).otherwise(F.char_length(old) <= F.char_length(new))


def populated(analysis: Column) -> Column:
    said = lambda c: F.coalesce(analysis[c] != "", F.lit(False))
    listed = lambda c: F.coalesce(F.size(analysis[c]) > 0, F.lit(False))
    return said("summary") | said("suitable_for") | listed("skills") | listed("references")


def merge_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows (id, columns of ``ENTITY``) as one row for each id, of the columns of ``ENTITY``.

    Blanks inherit, unless a newer analyser read the same page anew.  Of different
    values of two pages the more trusted one's stays, and equal trust clears both.
    A status doesn't go back on another page of no higher trust.  Address and trust
    go together.  ``upsert.merge`` is the same for announcements in a row.
    """
    a = complete(old).select("id", *(F.col(c).alias(f"_{c}") for c in ENTITY), F.lit(True).alias("_had"))
    both = a.join(complete(new).select("id", *ENTITY, F.lit(True).alias("_has")), "id", "full")
    pair = both.where("_had and _has").drop("_had", "_has")
    alone = lambda has, mark: both.where(F.col(has).isNull()).select("id", *(F.col(f"{mark}{c}").alias(c) for c in ENTITY))
    was, now = lambda c: F.col(f"_{c}"), F.col
    blank = lambda c: now(c) == ""
    pair = pair.withColumns({"_same": was("official_url") == now("official_url"), "_ours": trust_rank(was("trust")), "_theirs": trust_rank(now("trust"))})
    pair = pair.withColumn("_anew", F.col("_same") & ~blank("analyzer_version") & (now("analyzer_version") != was("analyzer_version")))
    same, anew, ours, theirs = (F.col(c) for c in ("_same", "_anew", "_ours", "_theirs"))

    stays = {"name": old_name_stays(was("name"), now("name")), "organizer": blank("organizer") & ~anew, "eligibility_note": blank("eligibility_note") & ~anew}
    stays |= dict.fromkeys(("status", "status_evidence"), blank("status_evidence") & ~anew)
    stays |= {c: (now(c) == "unknown") & ~anew for c in ("registration_phase", "competition_phase")}
    stays |= {c: blank(told) & ~anew for told, columns, _ in STATED for c in columns}
    stays |= {c: blank(c) for c in ("content", "fit_reason", "analyzer_version")} | {"analysis": ~populated(now("analysis"))}
    step = {c: F.when(keep, was(c)).otherwise(now(c)) for c, keep in stays.items()}
    facts = merge_facts(was("facts"), now("facts"), same | (theirs >= ours))
    step |= {"keywords": union_keywords(was("keywords"), now("keywords")), "facts": F.when(anew, F.coalesce(now("facts"), F.create_map().cast(ENTITY["facts"]))).otherwise(facts), "first_seen": was("first_seen")}
    pair = normalized(pair.withColumns(step))

    back = ~same & (rank(was("status"), STATUS, 0) > rank(now("status"), STATUS, 0)) & (ours >= theirs)
    step = {c: F.when(back, was(c)).otherwise(now(c)) for c in ("status", "status_evidence", "registration_phase", "competition_phase")}
    step |= {c: F.when(ours > theirs, was(c)).otherwise(now(c)) for c in ("official_url", "trust")}
    gone = F.array()
    for told, columns, fact in STATED:
        differ = ~same & (was(told) != "") & ~blank(told) & (was(told) != now(told))
        for c in columns:
            cleared = F.lit(None).cast("timestamp") if c in DATES else F.lit("")
            step[c] = F.when(differ & (ours > theirs), was(c)).when(differ & (ours == theirs), cleared).otherwise(now(c))
        gone = F.concat(gone, F.when(differ & (ours == theirs), F.array(F.lit(fact))).otherwise(F.array()))
    # told beforehand: in a lambda the names of columns that the same step sets would mean what it sets
    pair = pair.withColumn("_gone", gone.cast("array<string>"))
    step["facts"] = F.map_filter("facts", lambda k, _: ~F.array_contains("_gone", k))
    merged = normalized(pair.withColumns(step)).select("id", *ENTITY)
    return merged.unionByName(alone("_has", "_")).unionByName(alone("_had", ""))

"""Analysis of announcement pages by rules, and what is decided on each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.common import written
from tidemark.functions import analysis, dates
from tidemark.functions import markers as m
from tidemark.functions.lifecycle import composite_status, fact_confidence, phases
from tidemark.functions.text import clean_title, contains_any, entity_key, evidence_at, evidence_window, first_non_empty, let, normalize_space, year_from_text
from tidemark.operators.scoring import FIELD, Lexicon, candidate_score

LEAST_SCORE, SURE_SCORE = 15, 60
#: Columns that a deferred page loses.
UNCERTAIN = ["status_evidence", "organizer", "team_requirement", "fee", "fee_evidence", "eligibility_note"]


def page_body() -> Column:
    return normalize_space(F.concat_ws(" ", "title", "candidate_title", "text"))


def analyse(pages: DataFrame, now: Column, lexicon: Lexicon = FIELD) -> DataFrame:
    """Add what the rules find in ``pages`` (title, candidate_title, text, url, trust, is_listing).

    Adds body, name, organizer, status, status_evidence, phases, dates with their
    raw texts, team, fee, content, tags, score, eligibility, reason and entity key.
    An open registration whose end (or every conflicting end) is past is closed;
    one without an end counts only if the name or its evidence names this or a
    later year.
    """
    today = F.date_trunc("day", now)
    read = pages.withColumn("body", page_body()).withColumns({
        "name": clean_title(first_non_empty(F.col("title"), F.col("candidate_title"))),
        "organizer": analysis.organizer(F.col("body")),
        "_s": analysis.detect_status(F.col("body")),
        "_r": dates.registration_dates(F.col("body")),
        "_c": dates.competition_dates(F.col("body")),
        "_ends": dates.registration_deadlines(F.col("body")),
        "team_requirement": F.coalesce(analysis.team_requirement(F.col("body")), F.lit("")),
        "_f": analysis.fee(F.col("body")),
        "content": F.coalesce(analysis.content(F.col("body"), lexicon.positive), F.lit("")),
        "keywords": analysis.tags(F.col("body")),
        "reason": analysis.recommendation(F.col("body")),
        "score": candidate_score(F.concat_ws(" ", "candidate_title", "title"), F.col("body"), lexicon),
        "problem_released": analysis.problem_released(F.col("body")),
    })
    end, said = F.col("_r.end"), F.col("_s.status")
    late = (end < today) | (end.isNull() & (F.size("_ends") > 0) & F.forall("_ends", lambda e: e < today))
    opened = F.when((said == "registration_open") & F.coalesce(late, F.lit(False)), "registration_closed").otherwise(said)
    year = year_from_text(F.concat_ws(" ", "name", F.coalesce("_s.evidence", F.lit(""))))
    vague = (F.col("_said") == "registration_open") & end.isNull() & ((year == 0) | (year < F.year(now)))
    undergraduate = F.contains("body", F.lit("本科生")) & contains_any(F.concat_ws(" ", "name", "body"), lexicon.focus)
    judged = read.withColumn("_said", opened).withColumns({
        "status": F.coalesce(F.when(~F.coalesce(vague, F.lit(False)), F.col("_said")), F.lit("unknown")),
        "status_evidence": F.coalesce(F.when(~F.coalesce(vague, F.lit(False)), F.col("_s.evidence")), F.lit("")),
        "eligibility_note": F.when(undergraduate, m.ELIGIBILITY_NOTE).otherwise(""),
        "fit_score": let(F.when(undergraduate, F.greatest(F.lit(0), F.col("score") - 20)).otherwise(F.col("score")), lambda s: F.least(F.lit(100), F.greatest(F.lit(0), s))),
    })
    named = phases(F.col("status"))
    out = judged.withColumns({
        "registration_phase": named["registration"],
        "competition_phase": named["competition"],
        "entity_key": entity_key(F.col("name"), F.col("organizer"), m.KEY_NOISE),
        "fee": F.coalesce("_f.fee", F.lit("")),
        "fee_evidence": F.coalesce("_f.evidence", F.lit("")),
        **{f"{kind}_{part}": F.col(f"_{kind[0]}.{part}") for kind in ("registration", "competition") for part in ("start", "start_raw", "end", "end_raw")},
    })
    return out.drop("_s", "_r", "_c", "_f", "_ends", "_said")


#: What ``analyse`` and, beside it, ``decide`` read.
ANALYSED = ("title", "candidate_title", "text")
DECIDED = (*ANALYSED, "url", "is_listing")


def once_each(rows: DataFrame, read: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``work`` adds to those of ``read``, done once for all rows that agree in these.

    ``work`` keeps the rows and columns that it gets and reads no others.  What it
    adds is written, so that its true size decides how it's joined.
    """
    found = written(work(rows.select(*read).distinct()))
    own = found.select(*(F.col(c).alias(f"_{c}") if c in read else F.col(c) for c in found.columns))
    alike = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in read))
    return rows.join(own, alike).drop(*(f"_{c}" for c in read))


def decide(analysed: DataFrame) -> DataFrame:
    """Add ``low_value`` and ``decision`` to rows of ``analyse``.

    Pages of no value and of a low score are dropped; what is unclear, or claims a
    status, goes to a model; the rest is accepted as it is.
    """
    low = analysis.low_value_reason(F.concat_ws(" ", "candidate_title", "title"), F.col("body"), F.col("url"), F.col("is_listing"))
    unsure = (F.col("score") < SURE_SCORE) | (F.col("organizer") == "") | (F.col("content") == "") | (F.col("status") != "unknown")
    decision = F.when(F.col("low_value").isNotNull(), "drop").when(F.col("score") < LEAST_SCORE, "drop").when(unsure, "model").otherwise("accept")
    return analysed.withColumn("low_value", low).withColumn("decision", decision)


def pending(analysed: DataFrame) -> DataFrame:
    """Rows that a model still has to read keep their identity only; of low trust or no name none is left."""
    kept = analysed.where((F.col("trust") != "low") & (F.trim("name") != ""))
    cleared = {c: F.lit("") for c in UNCERTAIN}
    cleared |= {f"{kind}_{part}": F.lit(None).cast(analysed.schema[f"{kind}_{part}"].dataType) for kind in ("registration", "competition") for part in ("start", "start_raw", "end", "end_raw")}
    cleared |= {"status": F.lit("unknown"), "registration_phase": F.lit("unknown"), "competition_phase": F.lit("unknown"), "problem_released": F.lit(False)}
    return kept.withColumns(cleared).withColumn("entity_key", entity_key(F.col("name"), F.lit(""), m.KEY_NOISE))


def facts(analysed: DataFrame, published: str = "published") -> DataFrame:
    """Rows (*keys of ``analysed``, field, value, evidence, edition, confidence): what a page states, with what backs it.

    A fact without a value or without evidence isn't one.
    """
    year = year_from_text(F.concat_ws(" ", "name", "status_evidence"))
    edition = F.when(year > 0, year.cast("string")).otherwise("")
    near = lambda c: F.when(c != "", evidence_around(F.col("body"), c))
    stated = {
        "organizer": (F.col("organizer"), evidence_window(F.col("body"), ["主办方", "主办单位", "主办机构"])),
        **{f"{k}_{p}": (F.col(f"{k}_{p}_raw"), near(F.col(f"{k}_{p}_raw"))) for k in ("registration", "competition") for p in ("start", "end")},
        "team_requirement": (F.col("team_requirement"), F.col("team_requirement")),
        "fee": (F.col("fee"), F.col("fee_evidence")),
        "content": (F.col("content"), F.col("content")),
        "eligibility": (F.col("eligibility_note"), evidence_window(F.col("body"), ["本科生", "研究生", "参赛对象"])),
        "published_at": (F.col(published), F.col(published)),
        "registration_state": (F.nullif("registration_phase", F.lit("unknown")), F.col("status_evidence")),
        "competition_state": (F.nullif("competition_phase", F.lit("unknown")), F.col("status_evidence")),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("field"), F.trim(v).alias("value"), normalize_space(e).alias("evidence")) for k, (v, e) in stated.items()))
    each = analysed.withColumn("edition", edition).select("id", "trust", published, "edition", F.explode(rows).alias("f")).select("id", "trust", published, "edition", "f.*")
    backed = each.where((F.col("value") != "") & (F.col("evidence") != ""))
    return backed.select("id", "field", "value", "evidence", "edition", fact_confidence(F.col("trust"), F.col("evidence"), F.col("edition"), F.col(published)).alias("confidence"))


def evidence_around(text: Column, said: Column) -> Column:
    """The sentence part around the first place where ``said`` stands."""
    return let(F.instr(text, said), lambda at: F.when(at > 0, evidence_at(text, at)))


def normalized(rows: DataFrame) -> DataFrame:
    """Phases filled from a status where both are unknown, and the status that they make."""
    both = rows.withColumns({c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")) for c in ("registration_phase", "competition_phase")})
    bare = (F.col("registration_phase") == "unknown") & (F.col("competition_phase") == "unknown")
    old = phases(F.col("status"))
    filled = both.withColumns({"_r": F.when(bare, old["registration"]).otherwise(F.col("registration_phase")), "_c": F.when(bare, old["competition"]).otherwise(F.col("competition_phase"))})
    return filled.withColumns({"registration_phase": F.col("_r"), "competition_phase": F.col("_c"), "status": composite_status(F.col("_r"), F.col("_c"))}).drop("_r", "_c")

"""What an announcement page is and says, as Column expressions over its text.

Texts are expected with white space folded (``normalize_space``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import markers as m
from tidemark.functions.text import contains_any, evidence_at, evidence_window, has_any, let, marker_position, marker_text, normalize_ends, terms_in
from tidemark.functions.urls import host, in_domains


def university_site(url: Column) -> Column:
    return F.coalesce(F.endswith(host(url), F.lit(".edu.cn")), F.lit(False))


def low_value_reason(title: Column, text: Column, url: Column, is_listing: Column) -> Column:
    """Why a page isn't worth analysing; null if it may be."""
    both = F.concat_ws(" ", title, text)
    forward = contains_any(title, m.STRONG_FORWARD)
    campus_title = forward | (contains_any(title, m.NOTICE_TITLES) & contains_any(title, m.UNIVERSITY_OFFICES))
    internal = (contains_any(both, m.CAMPUS) | campus_title) & ~contains_any(text, m.PUBLIC)
    return (
        F.when(is_listing, "structural listing page")
        .when(contains_any(title, m.POST_EVENT_TITLES), "post-event news")
        .when(contains_any(title, m.LISTING_TITLES), "generic listing page")
        .when(contains_any(marker_text(both), m.EXPLICIT_CAMPUS), "explicit campus-internal competition")
        .when(university_site(url) & forward, "campus-internal forwarding announcement")
        .when(university_site(url) & internal, "campus-internal announcement")
    )


def detect_status(text: Column) -> Column:
    """Struct (status, evidence) of the first group of markers that occurs; null if none does."""

    def group(status: str, markers: list[str] | None) -> Column:
        evidence = evidence_window(text, markers) if markers else F.nullif(F.regexp_extract(text, m.UPCOMING, 0), F.lit(""))
        return let(evidence, lambda e: F.when(e.isNotNull(), F.struct(F.lit(status).alias("status"), e.alias("evidence"))))

    return F.coalesce(*(group(*g) for g in m.STATUS_MARKERS))


def organizer(text: Column) -> Column:
    return normalize_ends(F.regexp_extract(text, m.ORGANIZER, 1))


def team_requirement(text: Column) -> Column:
    return evidence_window(text, m.TEAM)


def fee(text: Column) -> Column:
    """Struct (fee, evidence): free by a marker, else the first amount; null if neither is said."""
    free = let(marker_position(text, m.FREE), lambda at: F.when(at > 0, F.struct(F.lit(m.FREE_FEE).alias("fee"), evidence_at(text, at).alias("evidence"))))
    said = F.regexp_extract(text, m.FEE, 0)
    amount = let(said, lambda s: F.when(s != "", F.struct(normalize_ends(F.regexp_extract(s, m.FEE, 1)).alias("fee"), evidence_at(text, F.instr(text, s)).alias("evidence"))))
    return F.coalesce(free, amount)


def unique_terms(terms: list[str]) -> list[str]:
    """Terms sorted, the first of each spelling."""
    first: dict[str, str] = {}
    for term in terms:
        first.setdefault(term.strip().lower(), term.strip())
    return sorted(v for k, v in first.items() if k)


def content(text: Column, keywords: list[str] = m.POSITIVE) -> Column:
    return evidence_window(text, unique_terms(keywords))


def recommendation(text: Column) -> Column:
    ladder = reduce(lambda w, pair: w.when(contains_any(text, pair[0]), pair[1]), m.REASONS[1:], F.when(contains_any(text, m.REASONS[0][0]), m.REASONS[0][1]))
    return ladder.otherwise(m.DEFAULT_REASON)


def tags(text: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(contains_any(text, terms), F.lit(name)) for name, terms in m.TAGS.items()))))


def problem_released(text: Column) -> Column:
    has = lambda t: F.contains(text, F.lit(t))
    return contains_any(text, m.PROBLEM_RELEASED) | (has("赛题发布") & ~has("赛题发布会"))


def challenge_page(text: Column) -> Column:
    """Whether a visible text is a bot challenge, also with its white space taken out."""
    return contains_any(text, m.CHALLENGE) | contains_any(F.translate(text, " \t\r\n", ""), m.CHALLENGE)


#: All that the labels of a profile look for.
LABEL_TERMS = [t for terms in (*m.CATEGORIES.values(), *m.ORGANIZER_TYPES.values(), *(terms for _, terms in m.SCOPES), m.REGIONS) for t in terms]


def categories(found: Column) -> Column:
    labels = F.array_compact(F.array(*(F.when(has_any(found, terms), F.lit(name)) for name, terms in m.CATEGORIES.items())))
    return let(labels, lambda x: F.when(F.size(x) == 0, F.array(F.lit("general"))).otherwise(x))


def organizer_types(found: Column, url: Column) -> Column:
    hits = {name: has_any(found, terms) for name, terms in m.ORGANIZER_TYPES.items()}
    hits["enterprise"] = hits["enterprise"] | let(host(url), lambda name: in_domains(name, m.ENTERPRISE_DOMAINS))
    labels = F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in hits.items())))
    return let(labels, lambda x: F.when(F.size(x) == 0, F.array(F.lit(m.UNSPECIFIED))).otherwise(x))


def regions(found: Column) -> Column:
    return F.array_intersect(F.array(*map(F.lit, m.REGIONS)), found)


def scope(found: Column) -> Column:
    """The one scope of a text, widest first."""
    out = F.lit(m.UNSPECIFIED)
    for name, terms in reversed(m.SCOPES):
        out = F.when(has_any(found, [*terms, *m.REGIONS] if name == "regional" else terms), name).otherwise(out)
    return out


def profile(text: Column, url: Column) -> Column:
    """Struct (categories, organizer_types, scopes, regions) of an entity's whole text, which is read once."""

    def labels(found: Column) -> Column:
        return F.struct(
            categories(found).alias("categories"),
            organizer_types(found, url).alias("organizer_types"),
            F.array(scope(found)).alias("scopes"),
            regions(found).alias("regions"),
        )

    return let(terms_in(text, LABEL_TERMS), labels)


#: All that the gate looks for in titles, and in texts.
GATE_TITLE_TERMS = [*m.GATE_POST_EVENT, *m.GATE_LISTINGS, *m.GATE_PREVIEW_FINAL, *m.GATE_STRONG_TITLES, *m.GATE_CAMPUS_TITLES, *m.GATE_POLICY, *m.GATE_POLICY_EXCEPT, m.GATE_FINAL, m.GATE_DELAYED]
GATE_TEXT_TERMS = [*m.GATE_CAMPUS, *m.GATE_PUBLIC]


def catalogue_eligible(title: Column, body: Column, status: Column, registration_end: Column, url: Column, trust: Column) -> Column:
    """The last gate before anything is told of an entity; ``body`` is its content and status evidence."""
    title = normalize_ends(title)
    seen = F.struct(terms_in(title, GATE_TITLE_TERMS).alias("title"), terms_in(F.concat_ws(" ", title, body), GATE_TEXT_TERMS).alias("text"))

    def refused(seen: Column) -> Column:
        named = lambda *terms: has_any(seen["title"], terms)
        strong = named(*m.GATE_STRONG_TITLES)
        campus = strong | named(*m.GATE_CAMPUS_TITLES)
        return (
            named(*m.GATE_POST_EVENT, *m.GATE_LISTINGS)
            | has_any(seen["text"], m.GATE_CAMPUS)
            | ((status == "preview") & named(m.GATE_FINAL) & ~named(*m.GATE_PREVIEW_FINAL))
            | (named(m.GATE_DELAYED) & registration_end.isNull())
            | (campus & university_site(url) & (strong | (trust != "high") | ~has_any(seen["text"], m.GATE_PUBLIC)))
            | (named(*m.GATE_POLICY) & ~named(*m.GATE_POLICY_EXCEPT))
        )

    return ~F.coalesce(let(seen, refused), F.lit(False))


def campus_rules_fallback(trust: Column, text: Column, source_role: Column, document_type: Column, fit_score: Column, dated_range: Column, focus: list[str] = m.FOCUS) -> Column:
    """Whether a page that a model took for a campus notice keeps what the rules found in it."""
    return F.coalesce(
        (trust != "low")
        & contains_any(text, focus)
        & ((source_role == "campus_forwarding") | (document_type == "campus_internal"))
        & ~document_type.isin("listing", "post_event_news", "community")
        & (fit_score >= 60)
        & ~contains_any(text, [*m.CAMPUS, *m.EXPLICIT_CAMPUS])
        & contains_any(text, m.PUBLIC_FALLBACK)
        & dated_range,
        F.lit(False),
    )


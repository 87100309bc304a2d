"""Scores and labels of candidate pages from marker lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import markers
from tidemark.functions.text import contains_any, let, literals, normalize_space
from tidemark.functions.urls import canonical_url, public_url, resolved


@dataclass(frozen=True)
class Lexicon:
    """Marker lists; the caller brings those of its language and field."""

    focus: list[str] = field(default_factory=list)
    positive: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    closed_titles: list[str] = field(default_factory=list)
    link_up: list[str] = field(default_factory=list)
    link_down: list[str] = field(default_factory=list)
    tags: dict[str, list[str]] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    segment: list[str] = field(default_factory=list)


#: The lists of the field.
FIELD = Lexicon(
    focus=markers.FOCUS,
    positive=markers.POSITIVE,
    negative=markers.NEGATIVE,
    closed_titles=[*markers.POST_EVENT_TITLES, *markers.LISTING_TITLES],
    link_up=markers.LINK_UP,
    link_down=markers.LINK_DOWN,
    tags=markers.TAGS,
    categories=markers.CATEGORIES,
    segment=markers.SEGMENT,
)


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur in already lower-case text."""
    return F.coalesce(let(text, lambda low: F.size(F.filter(literals(terms), lambda t: F.contains(low, t)))), F.lit(0))


def candidate_score(title: Column, snippet: Column, lexicon: Lexicon) -> Column:
    """-100 for a closed title, or for any negative term beside little else."""
    text = F.lower(F.concat_ws(" ", title, snippet))
    both = F.struct((100 * hits(text, lexicon.focus) + 15 * hits(text, lexicon.positive)).alias("good"), hits(text, lexicon.negative).alias("bad"))
    scored = let(both, lambda s: F.when((s["bad"] > 0) & (s["good"] < 30), -100).otherwise(s["good"] - 20 * s["bad"]))
    return F.when(contains_any(title, lexicon.closed_titles), -100).otherwise(scored)


def link_priority(text: Column, lexicon: Lexicon) -> Column:
    low = F.lower(text)
    return 10 * hits(low, lexicon.link_up) - 20 * hits(low, lexicon.link_down)


def labels(text: Column, groups: dict[str, list[str]], default: str | None = None) -> Column:
    """Sorted names of the groups of which any marker occurs."""
    found = F.array_compact(F.array(*(F.when(contains_any(text, terms), F.lit(name)) for name, terms in sorted(groups.items()))))
    return found if default is None else F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


#: An anchor with its address and what stands inside it.
ANCHOR = r"""(?is)<a\s[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)[^>]*>(.*?)</a\s*>"""
#: Anchors of a page that are looked at, in page order.
MOST_ANCHORS = 500


def page_links(pages: DataFrame, lexicon: Lexicon, most: int, page_id: str = "page_id", html: str = "html", most_anchors: int = MOST_ANCHORS, url: str | None = None) -> DataFrame:
    """Rows (page_id, pos, href, title, priority, place): anchors of a page in order of priority.

    With the page's address in ``url``, what an anchor means there follows as ``url``
    in canonical form, and anchors of addresses that aren't public don't count.

    The title is the text inside an anchor, without markup.  Titles of under four
    characters, empty addresses, scripts and mail addresses don't count.  Of the
    others the first ``most_anchors`` in page order are put in order of priority,
    and ``most`` stay (the top of the list is the feature).
    """
    anchors = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(0))
    base = [F.col(url).alias("base")] if url else []
    each = pages.select(page_id, *base, F.posexplode(anchors).alias("pos", "anchor"))
    bare = F.regexp_replace(F.regexp_extract("anchor", ANCHOR, 2), "<[^>]*>", "")
    for name, character in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(character))
    href = F.trim(F.regexp_replace(F.regexp_extract("anchor", ANCHOR, 1), r"""^["']|["']$""", ""))
    cut = each.select(page_id, *(["base"] if url else []), "pos", href.alias("href"), normalize_space(bare).alias("title"))
    kept = cut.where((F.char_length("title") >= 4) & (F.col("href") != "") & ~F.col("href").rlike("^(javascript|mailto):"))
    if url:
        kept = kept.withColumn("url", resolved(F.col("base"), F.col("href"))).where(public_url(F.col("url"))).withColumn("url", canonical_url(F.col("url"))).drop("base")
    early = kept.withColumn("turn", F.row_number().over(Window.partitionBy(page_id).orderBy("pos"))).where(F.col("turn") <= most_anchors).drop("turn")
    ranked = early.withColumn("priority", link_priority(F.col("title"), lexicon))
    order = Window.partitionBy(page_id).orderBy(F.desc("priority"), "pos")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def candidates(pages: DataFrame, lexicon: Lexicon, most: int, page_id: str = "page_id", html: str = "html", url: str = "url", title: str | None = None, text: str | None = None, listing: str | None = None) -> DataFrame:
    """Rows (page_id, place, url, title, snippet): the page itself unless it is a listing, then its links, ``most`` in all.

    An address stands once in a page, at its best place.  Titles, texts and listing
    flags come from columns, where the table has them.
    """
    links = page_links(pages, lexicon, 1 << 30, page_id, html, url=url).select(page_id, "place", "url", "title", F.col("title").alias("snippet"))
    cell = lambda c: F.coalesce(F.col(c), F.lit("")) if c else F.lit("")
    own = pages.where(~F.coalesce(F.col(listing), F.lit(False))) if listing else pages
    itself = own.where(F.col(url).isNotNull()).select(page_id, F.lit(0).alias("place"), canonical_url(F.col(url)).alias("url"), cell(title).alias("title"), F.left(cell(text), F.lit(500)).alias("snippet"))
    in_order = Window.partitionBy(page_id).orderBy("place")
    top = itself.unionByName(links).withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= most)
    once = top.withColumn("_turn", F.row_number().over(Window.partitionBy(page_id, "url").orderBy("place"))).where("_turn = 1").drop("_turn")
    return once.withColumn("place", F.row_number().over(in_order))


def top_segments(segments: DataFrame, lexicon: Lexicon, most: int, doc: str, position: str, text: str, title: Column | None = None) -> DataFrame:
    """The ``most`` best-scored segments of each document, with their ``place`` in page order.

    A marker counts 20, a word of the title of three characters or more 8, and
    the first segment gets ten points more.
    """
    low = F.lower(text)
    score = 20 * hits(low, lexicon.segment) + F.when(F.col(position) == 0, 10).otherwise(0)
    if title is not None:
        words = F.filter(F.split(F.lower(normalize_space(title)), " "), lambda w: F.char_length(w) >= 3)
        score = score + 8 * F.coalesce(F.size(F.filter(words, lambda w: F.contains(low, w))), F.lit(0))
    best = Window.partitionBy(doc).orderBy(F.desc("score"), position)
    chosen = segments.withColumn("score", score).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= most)
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(position))).drop("_rank")

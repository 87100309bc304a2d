"""Text normalisation, identity keys and evidence windows, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.markers import IGNORED, LONG_REGIONS, NOT_PUBLISHED, REGION_SUFFIXES, REGIONS

#: Characters that end an evidence sentence, and its reach.
SENTENCE_ENDS = "。！？!?；;\n"
EVIDENCE_BEFORE, EVIDENCE_SPAN = 80, 160
#: All that Unicode calls white space.
WHITE_SPACE = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def normalize_space(c: Column) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def search_norm(c: Column) -> Column:
    """Lower case, letters and decimal digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", "")


def identity_norm(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)\s", ""))


def without_phrases(c: Column, phrases: list[str]) -> Column:
    for phrase in phrases:
        c = F.replace(c, F.lit(phrase), F.lit(""))
    return c


def competition_name(c: Column, noise: list[str]) -> Column:
    """Name without noise phrases (in their order) and years, for comparison."""
    return search_norm(F.regexp_replace(without_phrases(F.lower(c), noise), r"20\d{2}", ""))


def entity_key(name: Column, organizer: Column, noise: list[str]) -> Column:
    """Key of an entity; a digest where nothing is left of the name."""
    base = F.lower(F.concat_ws("|", name, organizer))
    key = F.regexp_replace(without_phrases(base, noise), r"[^\p{L}\p{Nd}]", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.left(F.sha2(base, 256), F.lit(24)))


def clean_title(c: Column) -> Column:
    """The title up to the first separator whose left part has six characters."""
    out = F.trim(c)
    for mark in (" | ", " - ", "_"):
        head = F.trim(F.substring_index(out, mark, 1))
        out = F.when(F.contains(out, F.lit(mark)) & (F.char_length(head) >= 6), head).otherwise(out)
    return out


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


def literals(terms: list[str]) -> Column:
    """The terms in lower case as one array."""
    return F.array(*(F.lit(t.lower()) for t in terms)) if terms else F.array().cast("array<string>")


def contains_any(c: Column, terms: list[str]) -> Column:
    """Whether any term occurs in ``c``, whatever its case; false for null."""
    if not terms:
        return F.lit(False)
    return F.coalesce(F.lower(c).rlike("|".join(re.escape(t.lower()) for t in terms)), F.lit(False))


def alternatives(terms: list[str], most: int = 4) -> str:
    """A pattern that takes the longest of ``terms`` that begins at a place.

    Terms are told apart by ranges of their first characters, so that a place is
    compared with few of them.
    """
    heads = sorted({t[0] for t in terms})
    if len(heads) <= most:
        return "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    step = -(-len(heads) // most)
    ranges = [heads[i : i + step] for i in range(0, len(heads), step)]
    return "|".join(f"(?=[\\x{{{ord(r[0]):x}}}-\\x{{{ord(r[-1]):x}}}])(?:{alternatives([t for t in terms if t[0] in r], most)})" for r in ranges)


def terms_in(c: Column, terms: list[str]) -> Column:
    """All of ``terms``, in lower case, that occur in ``c``, whatever its case, found in one pass; none for null.

    A term that occurs more than once, or within another one, is listed as often.
    """
    low = sorted({t.lower() for t in terms})
    found = F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(f"(?=({alternatives(low)}))"), F.lit(1)), literals([]))
    # the pattern takes one term at a place; those that it begins with stand there, too
    within = {t: [s for s in low if t.startswith(s)] for t in low}
    nested = F.create_map(*(x for t, s in within.items() if len(s) > 1 for x in (F.lit(t), literals(s))))
    if all(len(s) == 1 for s in within.values()):
        return found
    return F.flatten(F.transform(found, lambda t: F.coalesce(F.try_element_at(nested, t), F.array(t))))


def has_any(found: Column, terms: list[str]) -> Column:
    """Whether one of ``terms`` is among those that ``terms_in`` found."""
    return F.arrays_overlap(found, literals(terms))


def marker_position(c: Column, markers: list[str]) -> Column:
    """Where the first marker, in list order, that occurs in ``c`` begins; 0 if none does."""
    low = F.lower(c)
    return let(low, lambda t: F.coalesce(*(F.nullif(F.instr(t, F.lit(m.lower())), F.lit(0)) for m in markers), F.lit(0)))


def evidence_at(c: Column, at: Column) -> Column:
    """The sentence part around the character position ``at``."""
    before = F.substring(c, F.greatest(at - EVIDENCE_BEFORE, F.lit(1)), F.least(F.lit(EVIDENCE_BEFORE), at - 1))
    after = F.substring(c, at, F.lit(EVIDENCE_SPAN))
    return normalize_ends(F.concat(F.regexp_extract(before, rf"([^{SENTENCE_ENDS}]*)\z", 1), F.regexp_extract(after, f"^([^{SENTENCE_ENDS}]*)", 1)))


def normalize_ends(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def evidence_window(c: Column, markers: list[str]) -> Column:
    """The sentence part around the first marker, in list order, that occurs; else null."""
    return let(marker_position(c, markers), lambda at: F.when(at > 0, evidence_at(c, at)))


def marker_text(c: Column) -> Column:
    """Text without the white space and punctuation that campus markers may be split by."""
    return F.translate(c, IGNORED, "")


def path_title(c: Column) -> Column:
    """The last segment of a path."""
    return F.coalesce(F.nullif(F.element_at(F.split(F.regexp_replace(c, "^/+|/+$", ""), "/"), -1), F.lit("")), F.lit(""))


def first_non_empty(*values: Column) -> Column:
    """The first value that isn't blank, else the placeholder of what isn't known."""
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in values), F.lit(NOT_PUBLISHED))


def year_from_text(c: Column) -> Column:
    """The first year 20xx, else 0."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, r"20\d{2}", 0), F.lit("")), F.lit("9999")).cast("int"), F.lit(0))


def edition(c: Column) -> Column:
    """The first ordinal of the form 第…届, else ''."""
    return F.regexp_extract(c, "第[一二三四五六七八九十百零〇0-9]+届", 0)


def same_edition(left: Column, right: Column) -> Column:
    a, b = year_from_text(left), year_from_text(right)
    return F.when((a > 0) & (b > 0), a == b).otherwise(identity_norm(left) == identity_norm(right))


def bigrams(c: Column) -> Column:
    """All pairs of neighbouring characters, in order; empty for under two."""
    n = F.char_length(c)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def keyword_list(c: Column, most: int = 20, longest: int = 40) -> Column:
    """Keywords split at line ends, commas and semicolons: trimmed, sorted, the first of each spelling.

    Spellings that differ by case only are one.  Null where a keyword is longer
    than ``longest`` characters or more than ``most`` are left: such a list is refused.
    """
    parts = F.filter(F.transform(F.split(c, "[\\n\\r,，;；]"), normalize_ends), lambda x: x != "")
    kept = distinct_ignoring_case(parts)
    return let(kept, lambda k: F.when(~(F.exists(k, lambda x: F.char_length(x) > longest) | (F.size(k) > most)), F.array_sort(k)))


def distinct_ignoring_case(values: Column) -> Column:
    """The first of values that are equal but for case, in order."""
    keys = F.transform(values, F.lower)
    return F.filter(values, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def region_list(c: Column) -> Column:
    """Regions of a keyword list by their short names, sorted; null where one isn't known."""
    long = F.create_map(*(F.lit(x) for pair in LONG_REGIONS.items() for x in pair))

    def short(x: Column) -> Column:
        cut = x
        for suffix in REGION_SUFFIXES:
            cut = F.regexp_replace(cut, f"{suffix}$", "")
        return F.coalesce(F.try_element_at(long, x), cut)

    names = F.transform(keyword_list(c), short)
    known = F.array(*map(F.lit, REGIONS))
    return F.when(F.forall(names, lambda x: F.array_contains(known, x)), F.array_sort(names))


def content_hash(c: Column) -> Column:
    return F.sha2(normalize_space(c), 256)


def segments(c: Column, most: int = 2_800) -> Column:
    """Paragraphs packed, in order, into segments of ``most`` characters or so.

    Paragraphs end at line ends and full stops.  One that would make a segment
    longer than ``most`` (the joining space isn't counted) begins the next; one
    that is longer by itself ends the open segment and is cut into pieces.
    Null and blank texts have no segments.
    """
    parts = F.filter(F.transform(F.split(F.replace(c, F.lit("。"), F.lit("。\n")), "\n"), normalize_space), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    closed = lambda done, text: F.when(text == "", done).otherwise(F.concat(done, F.array(text)))

    def add(state, part):
        done, text, size = state["done"], state["open"], F.char_length(part)
        pieces = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / most).cast("int")), lambda i: F.substring(part, i * most + 1, F.lit(most)))
        cut = F.struct(F.concat(closed(done, text), pieces).alias("done"), F.lit("").alias("open"))
        fresh = F.struct(closed(done, text).alias("done"), part.alias("open"))
        joined = F.struct(done.alias("done"), F.when(text == "", part).otherwise(F.concat(text, F.lit(" "), part)).alias("open"))
        return F.when(size > most, cut).when((text != "") & (F.char_length(text) + size > most), fresh).otherwise(joined)

    return F.coalesce(F.aggregate(parts, start, add, lambda s: closed(s["done"], s["open"])), F.array().cast("array<string>"))

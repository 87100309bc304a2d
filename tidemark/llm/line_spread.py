"""Line dedup by distinct-site spread, in DataFrame functions only.

For each distinct line one HyperLogLog sketch of its sites is merged by
aggregation.  Lines whose estimate is clearly at or above ``min_sites`` are
boilerplate; those within the sketch's error of it get an exact distinct count.
A boilerplate line stays where it stands first (smallest document id, then
position) and is removed everywhere else.

A line is the text between line feeds, as it stands; lines of spaces only are
never boilerplate.  It is identified by two 64-bit hashes.

Edge cases: null text counts as empty, null site as the site ''; rows of equal
id and text are one document and get equal results; rows of equal id and other
text are separate documents; null ids come first; an empty table gives an empty
result; extra columns are kept, and columns named ``n_lines`` or ``n_removed`` are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import field, named, packed, whole_text, written

SKETCH_BITS = 12
#: Standard errors within which an estimate isn't trusted.
DOUBT = 4.0


def text_lines(text: str | Column) -> Column:
    return F.split(whole_text(text), "\n")


def error_margin(min_sites: int, bits: int = SKETCH_BITS) -> int:
    return max(1, math.ceil(DOUBT * 1.04 / math.sqrt(1 << bits) * min_sites))


def line_rows(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """One short row for each line with a character other than the space."""
    cut = docs.select(
        named(doc_id).alias("id"),
        F.xxhash64(whole_text(text)).alias("version"),
        F.coalesce(named(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(text_lines(text)).alias("pos", "line"),
    )
    return cut.where(F.trim("line") != "").select(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"), "site", "id", "version", "pos")


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """Rows (a, b, first) of lines on at least ``min_sites`` sites."""
    margin = error_margin(min_sites)
    sketched = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"), F.min(F.struct("id", "version", "pos")).alias("first"))
    spread = written(sketched.select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - margin))
    near = spread.where(F.col("sites") <= min_sites + margin)
    exact = lines.join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    clear = spread.where(F.col("sites") > min_sites + margin).select("a", "b", "first")
    return clear.unionByName(near.join(exact.select("a", "b"), ["a", "b"]).select("a", "b", "first"))


def remove_boilerplate(docs: DataFrame, min_sites: int, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines`` and ``n_removed``.

    No document is dropped here; one that loses every line keeps an empty text.
    """
    lines = line_rows(docs, doc_id, text, site)
    spread = written(boilerplate_lines(lines, min_sites))
    again = lines.join(spread, ["a", "b"]).where(~F.struct("id", "version", "pos").eqNullSafe(F.col("first")))
    gone = again.groupBy("id", "version").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    joined = packed(docs).join(gone, field(doc_id).eqNullSafe(F.col("id")) & (F.xxhash64(whole_text(field(text))) == F.col("version")), "left")
    kept = F.when(F.col("gone").isNull(), field(text)).otherwise(without_lines(text_lines(field(text)), F.col("gone")))
    return joined.select(
        *((kept if c == text else field(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")),
        F.size(text_lines(field(text))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def without_lines(lines: Column, gone: Column) -> Column:
    """The text of ``lines`` without those at the positions ``gone``, which are in order.

    It is put together from the runs between them, so the work is in proportion to the lines.
    """
    once = F.array(F.struct(lines.alias("lines"), F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines))).alias("at")))

    def joined(s: Column) -> Column:
        run = lambda i: F.slice(s["lines"], s["at"][i] + 2, s["at"][i + 1] - s["at"][i] - 1)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["at"]) - 2), run)), "\n")

    return F.transform(once, joined)[0]


def oracle(min_sites: int) -> str:
    return f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
spread AS (
  SELECT line, min(struct_pack(a := doc_id, b := pos)) AS first_seen FROM lines WHERE trim(line, ' ') <> ''
  GROUP BY line HAVING count(DISTINCT site) >= {min_sites}),
judged AS (
  SELECT l.doc_id, l.pos, l.line, s.line IS NOT NULL AND struct_pack(a := l.doc_id, b := l.pos) <> s.first_seen AS gone
  FROM lines l LEFT JOIN spread s ON l.line = s.line)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '') AS text
FROM judged GROUP BY doc_id
"""

"""Votes of segments, evidence checks and duplicate proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lifecycle import TRUST, rank
from tidemark.functions.text import identity_norm, let, normalize_space
from tidemark.operators.match import contained_forms


def consensus(votes: DataFrame, doc: str = "doc") -> DataFrame:
    """Rows (doc, value, edition, votes, conflict): the strict plurality of each document.

    ``votes`` has doc, value, edition, confidence, evidence.  A tie at the top
    clears the value; the representative is of the highest confidence, then the
    longest evidence in bytes, then the least evidence.
    """
    strength = F.struct(rank(F.col("confidence"), TRUST, 1).alias("c"), F.octet_length("evidence").alias("l"))
    tallied = votes.groupBy(doc, "value", "edition").agg(F.count("*").alias("votes"), F.max(strength).alias("best"))
    top = tallied.groupBy(doc).agg(F.max("votes").alias("_most"), F.count("*").alias("_choices"))
    led = tallied.join(top, doc).where("votes = _most")
    return led.groupBy(doc).agg(
        F.when(F.count("*") == 1, F.min("value")).alias("value"),
        F.when(F.count("*") == 1, F.min("edition")).alias("edition"),
        F.max("votes").cast("long").alias("votes"),
        (F.count("*") > 1).alias("conflict"),
    )


#: Why values of a field are refused.
UNRESOLVED = "unresolved conflicting values across document segments"
MINORITY = "minority conflicting values discarded by cross-segment consensus"


def fact_consensus(votes: DataFrame, keys: tuple[str, ...] = ("doc", "field")) -> DataFrame:
    """Rows (*keys, value, edition, evidence, confidence, conflict, reason, refused): one for each key with a value.

    ``votes`` has the keys, value, edition, confidence and evidence, one row for
    each segment.  Blank values don't vote.  Values are alike by their normal form
    and edition; without an edition the first year of the evidence is it.  The
    largest group wins, and a tie at the top clears the field.  The vote that
    speaks for a group has the highest confidence, then the longest evidence in
    bytes, then the least evidence.  ``refused`` lists the values that lost.
    """
    said = F.coalesce("edition", F.lit(""))
    year = F.regexp_extract(F.coalesce("evidence", F.lit("")), r"(?:19|20)\d{2}", 0)
    evidence = normalize_space(F.coalesce("evidence", F.lit("")))
    shown = F.struct((-rank(F.lower(F.trim("confidence")), TRUST, 1)).alias("c"), (-F.octet_length(evidence)).alias("l"), evidence.alias("evidence"), F.col("value"), said.alias("edition"), F.col("confidence"))
    keyed = votes.where(F.trim("value") != "").withColumns({"_v": identity_norm(F.col("value")), "_e": F.coalesce(F.nullif(identity_norm(said), F.lit("")), year)})
    groups = keyed.groupBy(*keys, "_v", "_e").agg(F.count("*").alias("n"), F.min(shown).alias("best"))
    parts = votes.groupBy(*keys).agg(F.count("*").alias("_parts"))
    one = F.struct("_v", "_e", "n", "best.value", "best.edition", "best.evidence", "best.confidence")
    # a field has no more groups than its document has segments
    held = groups.groupBy(*keys).agg(F.max("n").alias("_top"), F.array_sort(F.collect_list(one)).alias("_groups")).join(parts, list(keys))
    split = held.withColumns({"_first": F.filter("_groups", lambda g: g["n"] == F.col("_top")), "_others": F.filter("_groups", lambda g: g["n"] != F.col("_top"))})
    counted = lambda g: F.format_string("%s x%d", g["value"], g["n"])
    conflict, won = F.size("_first") > 1, F.col("_first")[0]
    lost = F.when(conflict, F.transform("_groups", counted)).when((F.size("_groups") > 1) & (F.col("_top") < F.col("_parts")), F.array_sort(F.transform("_others", counted)))
    kept = lambda c: F.when(~conflict, c)
    return split.select(
        *keys,
        kept(won["value"]).alias("value"),
        kept(F.coalesce(F.nullif(won["edition"], F.lit("")), won["_e"])).alias("edition"),
        kept(won["evidence"]).alias("evidence"),
        kept(won["confidence"]).alias("confidence"),
        conflict.alias("conflict"),
        F.when(conflict, UNRESOLVED).when(lost.isNotNull(), MINORITY).alias("reason"),
        F.array_join(lost, ", ").alias("refused"),
    )


#: Fields whose conflict leaves the lifecycle open, and the dates then withheld.
LIFECYCLE_FIELDS = ["identity.name", "identity.series", "identity.edition", "facts.registration_start", "facts.registration_end", "facts.competition_start", "facts.competition_end"]
WITHHELD = LIFECYCLE_FIELDS[3:]


def withhold_lifecycle(facts: DataFrame, doc: str = "doc") -> DataFrame:
    """Rows of ``fact_consensus`` without the dates of documents in whose lifecycle fields values conflict."""
    torn = facts.where(F.col("conflict") & F.col("field").isin(LIFECYCLE_FIELDS)).select(doc).distinct()
    dates = facts.where(F.col("field").isin(WITHHELD)).join(torn, doc, "left_anti")
    return facts.where(~F.col("field").isin(WITHHELD)).unionByName(dates)


def quoted(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (quote_id, text_id): the quote stands in the text, white space folded.

    Candidates share three inner words of the quote, which must be whole words
    of a text that holds it; quotes of under five words, and so all in scripts
    without spaces, are looked for in every text, in broadcast blocks.
    """
    q = quotes.select("quote_id", normalize_space(F.col("quote")).alias("quote")).where("quote <> ''")
    words = F.split("quote", " ")
    short = q.where(F.size(words) < 5).select(F.col("quote_id").alias("key"), F.col("quote").alias("form"))
    q = q.where(F.size(words) >= 5).withColumn("key", F.array_join(F.slice(words, 2, 3), " "))
    t = texts.select("text_id", normalize_space(F.col("text")).alias("body"))
    # a text is split once: inside the inner function it would be split anew at each of its words
    keys = let(F.split("body", " "), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))))
    found = t.select("text_id", F.explode(F.array_distinct(keys)).alias("key")).join(q.select("quote_id", "key"), "key").select("text_id", "quote_id").distinct()
    met = found.join(q.select("quote_id", "quote"), "quote_id").join(t, "text_id")
    long = met.where(F.contains("body", F.col("quote"))).select("quote_id", "text_id")
    return long.unionByName(contained_forms(t, short).select(F.col("key").alias("quote_id"), "text_id"))


def single_proposals(proposals: DataFrame, keys: list[str]) -> DataFrame:
    """Proposals whose key occurs once; a repeated key rejects all of its rows."""
    return proposals.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")

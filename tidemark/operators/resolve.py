"""Entity resolution by blocked similarity of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.markers import NAME_NOISE
from tidemark.functions.text import bigrams, competition_name, edition, let, search_norm, year_from_text

DICE = 0.78
#: From this on, organisers don't matter.
DICE_ALONE = 0.92
LEAST_NAME = 6


def labelled_bigrams(name: Column) -> Column:
    """The bigrams, each with its occurrence number, so that common ones of two names can be counted as a set."""
    number = lambda grams: F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string")))
    return let(bigrams(name), number)


def _names(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.col(name).alias("name")).where("name is not null").distinct()


def dice_pairs(names: DataFrame, name: str = "name", least: float = DICE) -> DataFrame:
    """Pairs (left_name, right_name, dice) of distinct names at or above ``least``, which is over 0.

    A pair can reach the threshold only if its names share so many bigrams that,
    with all bigrams in one order from rare to common, a shared one stands near
    the front of both.  Only these prefixes are joined, so a bigram that most
    names have blocks pairs of names only that have little else; no pair is lost.
    """
    share = least / (2 - least)  # of the longer one's bigrams, those that the shorter must have
    labelled = _names(names, name).where(F.char_length("name") > 1).select("name", (F.char_length("name") - 1).alias("size"), labelled_bigrams(F.col("name")).alias("grams"))
    grams = labelled.select("name", "size", F.explode("grams").alias("gram"))
    held = grams.groupBy("gram").agg(F.count("*").alias("held"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("held", "gram"))
    front = grams.join(held, "gram").withColumn("place", place).where((F.col("place") <= F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1) & (F.col("held") > 1))
    left = front.select("gram", F.col("name").alias("left_name"), F.col("size").alias("a"), F.col("place").alias("i"))
    right = front.select("gram", F.col("name").alias("right_name"), F.col("size").alias("b"), F.col("place").alias("j"))
    # After the first shared bigram, no more can be shared than what is left of either.
    reach = (F.least("a", "b") >= share * F.greatest("a", "b") - 1e-9) & (F.least(F.col("a") - F.col("i"), F.col("b") - F.col("j")) + 1 >= least / 2 * (F.col("a") + F.col("b")) - 1e-9)
    pairs = left.join(right, "gram").where((F.col("left_name") < F.col("right_name")) & reach).select("left_name", "right_name").distinct()
    one, two = (labelled.select(F.col("name").alias(f"{side}_name"), F.col("grams").alias(f"{side}_grams")) for side in ("left", "right"))
    met = pairs.join(one, "left_name").join(two, "right_name")
    shared = F.size(F.array_intersect("left_grams", "right_grams"))
    dice = F.round(2.0 * shared / (F.size("left_grams") + F.size("right_grams")), 6)
    return met.select("left_name", "right_name", dice.alias("dice")).where(F.col("dice") >= least)


def contained_pairs(names: DataFrame, name: str = "name") -> DataFrame:
    """Pairs (left_name, right_name, dice) of distinct names of which one stands in the other.

    A name that holds another has all of its bigrams, so the rarest one blocks the
    pairs, and all bigrams of the shorter are shared.  Names under ``LEAST_NAME``
    are left out.
    """
    distinct = _names(names, name).where(F.char_length("name") >= LEAST_NAME)
    index = distinct.select("name", F.explode(F.array_distinct(bigrams(F.col("name")))).alias("gram"))
    held = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = index.join(held, "gram").groupBy("name").agg(F.min(F.struct("n", "gram")).alias("key")).select(F.col("name").alias("inner"), F.col("key.gram").alias("gram"))
    met = rarest.join(index.select("gram", F.col("name").alias("outer")), "gram").where((F.col("inner") != F.col("outer")) & F.contains("outer", F.col("inner")))
    a, b = F.char_length("inner") - 1, F.char_length("outer") - 1
    return met.select(F.least("inner", "outer").alias("left_name"), F.greatest("inner", "outer").alias("right_name"), F.round(2.0 * a / (a + b), 6).alias("dice"))


def identity_pairs(names: DataFrame, name: str = "name", least: float = DICE) -> DataFrame:
    """Pairs (left_name, right_name, dice) that are alike enough or contained."""
    return dice_pairs(names, name, least).unionByName(contained_pairs(names, name)).dropDuplicates(["left_name", "right_name"])


def with_identity(rows: DataFrame) -> DataFrame:
    """``rows`` with what identity looks at: ``name_key``, ``organizer_key``, ``edition_mark``, ``name_year`` and ``year``.

    Reads name, organizer and status_evidence.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    name, said = text(F.col("name")), text(F.col("status_evidence"))
    return rows.withColumns({
        "name_key": competition_name(name, NAME_NOISE),
        "organizer_key": search_norm(text(F.col("organizer"))),
        "edition_mark": edition(name),
        "name_year": year_from_text(name),
        "year": year_from_text(F.concat_ws(" ", name, said)),
    })


def editions_conflict(left, right) -> Column:
    """Whether two entities say different years or editions; both are functions from names to columns."""
    years = (left("year") != 0) & (right("year") != 0) & (left("year") != right("year"))
    return years | ((left("edition_mark") != "") & (right("edition_mark") != "") & (left("edition_mark") != right("edition_mark")))


def organizers_agree(left: Column, right: Column, alike: Column) -> Column:
    """Unknown, equal or one in the other; else the names must be alike enough alone."""
    return (left == "") | (right == "") | F.contains(left, right) | F.contains(right, left) | (alike >= DICE_ALONE)


def same_identity(pairs: DataFrame, least: float = DICE) -> DataFrame:
    """Pairs (left_name, right_name, dice) of names whose years and editions don't conflict and which are long enough."""
    l, r = F.col("left_name"), F.col("right_name")
    years = (year_from_text(l) == 0) | (year_from_text(r) == 0) | (year_from_text(l) == year_from_text(r))
    editions = (edition(l) == "") | (edition(r) == "") | (edition(l) == edition(r))
    long = (F.char_length(l) >= LEAST_NAME) & (F.char_length(r) >= LEAST_NAME)
    return pairs.where(years & editions & long & ((F.col("dice") >= least) | F.contains(l, r) | F.contains(r, l)))


LOOKS = ("name_key", "organizer_key", "edition_mark", "year")


def faces(rows: DataFrame, item: str = "id") -> DataFrame:
    """Rows (LOOKS, face): what rows that agree in name, organiser, edition and year share, by the least item."""
    known = with_identity(rows).where(F.char_length("name_key") >= LEAST_NAME)
    return known.groupBy(*LOOKS).agg(F.min(item).alias("face"))


def same_entities(rows: DataFrame, item: str = "id") -> DataFrame:
    """Pairs (left_id, right_id) of faces that tell of one entity, by name, year, edition and organiser.

    A face stands for all rows that agree with it, which aren't paired among
    themselves; ``faces`` says which these are.
    """
    known = faces(rows, item)
    alike = identity_pairs(known, "name_key")
    every = alike.unionByName(known.select(F.col("name_key").alias("left_name"), F.col("name_key").alias("right_name"), F.lit(1.0).alias("dice")).distinct())
    left, right = (known.select(*(F.col(c).alias(f"{side}_{c}") for c in (*LOOKS, "face"))) for side in ("left", "right"))
    met = every.join(left, F.col("left_name") == F.col("left_name_key")).join(right, F.col("right_name") == F.col("right_name_key"))
    fits = met.where(~editions_conflict(lambda c: F.col(f"left_{c}"), lambda c: F.col(f"right_{c}")) & organizers_agree(F.col("left_organizer_key"), F.col("right_organizer_key"), F.col("dice")))
    return fits.where("left_face <> right_face").select(F.least("left_face", "right_face").alias("left_id"), F.greatest("left_face", "right_face").alias("right_id")).distinct()

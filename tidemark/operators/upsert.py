"""Announcements folded into entities in their order: find the entity, then merge.

An announcement belongs to the entity of its key, else to the one of its address
unless they tell of different editions, else to the entity seen last that has the
same identity; if there is none, it makes one.  Merging changes what later ones are
compared with, so the order matters.  What can't meet is kept apart: announcements
are connected by key, by address and by likeness of names, and each component is
folded on its own.  A component's announcements stream through one task in order;
what is held is its entities, however many announcements tell of them.

Inputs: ``id`` (a number that rises with arrival), ``seen_at``, ``source_id`` and the
columns of ``ENTITY``; those that a table lacks, and nulls of texts, count as blank.
A blank key or address finds and connects nothing; a null ``seen_at`` counts as 1970.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.common import ship_package, written
from tidemark.functions.lifecycle import STATUS, TRUST
from tidemark.functions.markers import TITLE_NOISE
from tidemark.operators.graph import components
from tidemark.operators.pages import normalized
from tidemark.operators.resolve import DICE, DICE_ALONE, LEAST_NAME, identity_pairs, with_identity

FACT = "struct<value:string,raw:string,evidence:string,edition:string,source_url:string,confidence:string,observed_at:timestamp>"
ANALYSIS = "struct<summary:string,suitable_for:string,skills:array<string>,references:array<struct<title:string,url:string,evidence:string>>>"
TEXTS = ("entity_key", "name", "organizer", "status", "status_evidence", "registration_phase", "competition_phase", "team_requirement", "fee", "fee_evidence", "content", "fit_reason", "eligibility_note", "official_url", "trust", "analyzer_version", "content_hash")
DATES = ("registration_start", "registration_end", "competition_start", "competition_end")
#: Columns of an entity besides its id.
ENTITY = {
    **dict.fromkeys(TEXTS, "string"),
    **{k: v for d in DATES for k, v in ((d, "timestamp"), (f"{d}_raw", "string"))},
    "keywords": "array<string>",
    "analysis": ANALYSIS,
    "facts": f"map<string,{FACT}>",
    "fit_score": "int",
    "problem_released": "boolean",
    "first_seen": "timestamp",
    "last_seen": "timestamp",
}
IDENTITY = {"name_key": "string", "organizer_key": "string", "edition_mark": "string", "name_year": "int", "year": "int"}

#: What says a value, the columns that go with it, and the fact that tells of it.
STATED = [*((f"{d}_raw", (d, f"{d}_raw"), d) for d in DATES), ("team_requirement", ("team_requirement",), "team_requirement"), ("fee", ("fee", "fee_evidence"), "fee")]


def complete(rows: DataFrame) -> DataFrame:
    """``rows`` with every column of an entity; texts without null, phases and status made to agree."""
    have = dict(rows.dtypes)
    columns = {c: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind) for c, kind in ENTITY.items()}
    for c in (*TEXTS, *(f"{d}_raw" for d in DATES)):
        columns[c] = F.coalesce(columns[c], F.lit(""))
    others = [c for c in rows.columns if c not in ENTITY]
    return with_identity(normalized(rows.select(*others, *(v.alias(c) for c, v in columns.items()))))


def _trust(row: dict) -> int:
    return TRUST.get(row["trust"], 1)


def lifecycle(row: dict) -> None:
    """One status of two phases, the competition's first; phases of a status where both are unknown."""
    for c in ("registration_phase", "competition_phase"):
        row[c] = row[c] or "unknown"
    if row["registration_phase"] == row["competition_phase"] == "unknown":
        said = row["status"]
        row["registration_phase"] = {"registration_open": "open", "registration_closed": "closed", "preview": "preview"}.get(said, "unknown")
        row["competition_phase"] = said if said in ("upcoming", "ongoing", "finished") else "unknown"
    by_registration = {"open": "registration_open", "closed": "registration_closed", "preview": "preview"}
    later = row["competition_phase"]
    row["status"] = later if later in ("upcoming", "ongoing", "finished") else by_registration.get(row["registration_phase"], "unknown")


def better_name(old: str, new: str) -> bool:
    """Whether the old name stays: without noise before with, then the shorter, then the old one."""
    noisy = [any(n in name for n in TITLE_NOISE) for name in (old, new)]
    return noisy < noisy[::-1] if noisy[0] != noisy[1] else len(old) <= len(new)


def union_keywords(*lists: list[str] | None) -> list[str]:
    found: dict[str, str] = {}
    for word in (w.strip() for ws in lists for w in ws or () if w):
        if word:
            found.setdefault(word.lower(), word)
    return list(found.values())


def populated(analysis: dict | None) -> bool:
    return bool(analysis and any(analysis[c] for c in ("summary", "suitable_for", "skills", "references")))


def merge(old: dict, new: dict) -> dict:
    """The entity after an announcement.

    Blanks inherit, unless a newer analyser read the same page anew.  Of different
    values of two pages the more trusted one's stays, and equal trust clears both.
    """
    out = dict(new)
    same = old["official_url"] == new["official_url"]
    anew = same and new["analyzer_version"] not in ("", old["analyzer_version"])
    ours, theirs = _trust(old), _trust(new)

    def inherit(*columns: str) -> None:
        out.update({c: old[c] for c in columns})

    if better_name(old["name"], new["name"]):
        inherit("name", "name_key", "edition_mark", "name_year")
    if not anew:
        if not new["organizer"]:
            inherit("organizer", "organizer_key")
        if not new["status_evidence"]:
            inherit("status", "status_evidence")
        for c in ("registration_phase", "competition_phase"):
            if new[c] == "unknown":
                inherit(c)
        for told, columns, _ in STATED:
            if not new[told]:
                inherit(*columns)
        if not new["eligibility_note"]:
            inherit("eligibility_note")
    for c in ("content", "fit_reason", "analyzer_version"):
        if not new[c]:
            inherit(c)
    out["keywords"] = union_keywords(old["keywords"], new["keywords"])
    if not populated(new["analysis"]):
        inherit("analysis")
    before, after = dict(old["facts"] or ()), dict(new["facts"] or ())
    out["facts"] = after if anew else before | after if same or theirs >= ours else after | before
    lifecycle(out)
    if not same and STATUS.get(old["status"], 0) > STATUS.get(out["status"], 0) and ours >= theirs:
        inherit("status", "status_evidence", "registration_phase", "competition_phase")
    if ours > theirs:
        inherit("official_url", "trust")
    if not same:
        for told, columns, fact in STATED:
            if old[told] and out[told] and old[told] != out[told] and ours >= theirs:
                if ours > theirs:
                    inherit(*columns)
                else:
                    out.update({c: None if c in DATES else "" for c in columns})
                    out["facts"].pop(fact, None)
    lifecycle(out)
    out["year"] = out["name_year"] or _year(out["status_evidence"])
    out["first_seen"], out["last_seen"], out["entity_key"], out["id"] = old["first_seen"], new["seen_at"], old["entity_key"], old["id"]
    return out


def _year(text: str) -> int:
    at = -1
    while (at := text.find("20", at + 1)) >= 0:
        digits = text[at : at + 4]
        if len(digits) == 4 and all("0" <= d <= "9" for d in digits):
            return int(digits)
    return 0


class Component:
    """The entities of one component while its announcements pass."""

    def __init__(self) -> None:
        self.entities: dict[int, dict] = {}
        self.by_key: dict[str, int] = {}
        self.by_url: dict[str, set[int]] = {}
        self.by_name: dict[str, set[int]] = {}
        self.likeness: dict[tuple[str, str], float] = {}

    def alike(self, a: str, b: str) -> float:
        """Dice of two names, 0 if they are too far from each other and neither holds the other."""
        if (a, b) not in self.likeness:
            pairs = [Counter(x[i : i + 2] for i in range(len(x) - 1)) for x in (a, b)]
            value = round(2 * (pairs[0] & pairs[1]).total() / (len(a) + len(b) - 2), 6)
            self.likeness[a, b] = value if value >= DICE or a in b or b in a else 0.0
        return self.likeness[a, b]

    def find(self, row: dict) -> tuple[int | None, str]:
        if (found := self.by_key.get(row["entity_key"])) is not None:
            return found, "key"
        if known := self.by_url.get(row["official_url"]):
            found = min(known)
            if not conflict(self.entities[found], row):
                return found, "url"
        if len(row["name_key"]) < LEAST_NAME:
            return None, "new"
        best = None
        for name, ids in self.by_name.items():
            value = self.alike(name, row["name_key"]) if ids and len(name) >= LEAST_NAME else 0.0
            for i in ids if value else ():
                entity = self.entities[i]
                order = (entity["last_seen"], -i)
                if (best is None or order > best) and not conflict(entity, row) and agree(entity["organizer_key"], row["organizer_key"], value):
                    best = order
        return (None, "new") if best is None else (-best[1], "identity")

    def keep(self, entity: dict, *urls: str) -> None:
        before = self.entities.get(entity["id"])
        if before is None:
            if entity["entity_key"]:
                self.by_key.setdefault(entity["entity_key"], entity["id"])
        elif before["name_key"] != entity["name_key"]:
            self.by_name[before["name_key"]].discard(entity["id"])
        self.entities[entity["id"]] = entity
        self.by_name.setdefault(entity["name_key"], set()).add(entity["id"])
        for url in filter(None, urls):
            self.by_url.setdefault(url, set()).add(entity["id"])

    def take(self, row: dict) -> tuple[int, str]:
        found, how = self.find(row)
        if found is None:
            entity = row | {"first_seen": row["first_seen"] or row["seen_at"], "last_seen": row["seen_at"], "keywords": row["keywords"] or [], "facts": dict(row["facts"] or ())}
        else:
            entity = merge(self.entities[found], row)
        self.keep(entity, row["official_url"])
        return entity["id"], how


def conflict(a: dict, b: dict) -> bool:
    return bool(a["year"] and b["year"] and a["year"] != b["year"] or a["edition_mark"] and b["edition_mark"] and a["edition_mark"] != b["edition_mark"])


def agree(a: str, b: str, alike: float) -> bool:
    return not a or not b or a in b or b in a or alike >= DICE_ALONE


def connected(rows: DataFrame) -> DataFrame:
    """Rows (place, component, root): places whose announcements may meet in a fold.

    The place of an announcement is its key, or itself where that is blank.

    An entity's name is always the name of one of its announcements, so names that
    aren't alike, or that themselves say different years or editions, connect nothing.
    """
    looks = rows.select("place", F.explode("urls").alias("official_url"), "name_key", "edition_mark", "name_year").distinct()
    node = lambda kind, *columns: F.concat_ws("\x00", F.lit(kind), *columns)
    key, url = node("k", F.col("place")), node("u", F.col("official_url"))
    face = lambda side: node("n", *(F.col(f"{side}{c}").cast("string") for c in ("name_key", "edition_mark", "name_year")))
    faces = looks.select("name_key", "edition_mark", "name_year").where(F.char_length("name_key") >= LEAST_NAME).distinct()
    alike = identity_pairs(faces, "name_key").select("left_name", "right_name")
    every = alike.unionByName(faces.select(F.col("name_key").alias("left_name"), F.col("name_key").alias("right_name")).distinct())
    left, right = (faces.select(*(F.col(c).alias(f"{s}_{c}") for c in faces.columns)) for s in ("l", "r"))
    met = every.join(left, F.col("left_name") == F.col("l_name_key")).join(right, F.col("right_name") == F.col("r_name_key"))
    apart = ((F.col("l_name_year") > 0) & (F.col("r_name_year") > 0) & (F.col("l_name_year") != F.col("r_name_year"))) | ((F.col("l_edition_mark") != "") & (F.col("r_edition_mark") != "") & (F.col("l_edition_mark") != F.col("r_edition_mark")))
    edges = looks.where("official_url <> ''").select(key.alias("a"), url.alias("b")).unionByName(looks.select(key.alias("a"), face("").alias("b"))).unionByName(met.where(~apart).select(face("l_").alias("a"), face("r_").alias("b")))
    roots = components(written(edges.distinct()))
    places = looks.select("place", key.alias("node")).distinct()
    return places.join(roots, "node").select("place", F.xxhash64("root").alias("component"), "root")


def fold(announcements: DataFrame, entities: DataFrame | None = None, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities after all ``announcements``, the step of each, and the links.

    ``entities`` and ``links`` (id, source_id, url, trust, last_seen) are those of an
    earlier fold; ids of entities are below those of announcements.  Gives the
    entities (id, columns of ``ENTITY``; those that nothing told of are left as they
    were), the steps (id, entity, how: key, url, identity or new), and every link,
    the last one of each entity and address.
    """
    spark = announcements.sparkSession
    ship_package(spark)
    rows = complete(announcements).withColumns({"urls": F.array("official_url"), "known": F.lit(False)})
    rows = rows.drop(*(c for c in rows.columns if c not in ("id", "seen_at", "source_id", "urls", "known", *ENTITY, *IDENTITY)))
    if entities is not None:
        addresses = links.groupBy("id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
        known = complete(entities).join(addresses, "id", "left").withColumns({"urls": F.coalesce("urls", F.array("official_url")), "known": F.lit(True), "seen_at": F.col("last_seen"), "source_id": F.lit("")})
        rows = rows.unionByName(known.select(*rows.columns))
    rows = written(rows.withColumns({"seen_at": F.coalesce("seen_at", F.timestamp_seconds(F.lit(0))), "place": F.when(F.col("entity_key") == "", F.concat(F.lit("\x00"), F.col("id"))).otherwise(F.col("entity_key"))}))
    placed = rows.join(connected(rows), "place")
    named = ", ".join(f"{c}:{kind}" for c, kind in {"id": "long", **ENTITY}.items())
    schema = f"step struct<id:long,entity:long,how:string>, entity struct<{named}>"

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, component, kind = None, Component(), _entity_type()

        def flushed() -> Iterator[pa.RecordBatch]:
            some = list(component.entities.values())
            for at in range(0, len(some), 1_000):
                made = pa.array([{c: list(e[c].items()) if c == "facts" else e[c] for c in ("id", *ENTITY)} for e in some[at : at + 1_000]], kind)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(made), _STEP), made], ["step", "entity"])

        for batch in batches:
            steps = []
            for row in batch.to_pylist():
                if row["root"] != root:
                    yield from flushed()
                    root, component = row["root"], Component()
                if row["known"]:
                    component.keep(row | {"facts": dict(row["facts"] or ())}, *row["urls"])
                else:
                    entity, how = component.take(row)
                    steps.append({"id": row["id"], "entity": entity, "how": how})
            yield pa.RecordBatch.from_arrays([pa.array(steps, _STEP), pa.nulls(len(steps), kind)], ["step", "entity"])
        yield from flushed()

    ordered = placed.repartition("component").sortWithinPartitions("component", "root", F.desc("known"), "seen_at", "id")
    out = written(ordered.mapInArrow(folded, schema))
    steps = out.where("step is not null").select("step.*")
    told = rows.where("not known").select("id", "source_id", F.col("official_url").alias("url"), "trust", "seen_at")
    fresh = steps.join(told, "id").groupBy(F.col("entity").alias("id"), "url").agg(F.max_by(F.struct("source_id", "trust", F.col("seen_at").alias("last_seen")), F.struct("seen_at", "id")).alias("last")).select("id", "last.source_id", "url", "last.trust", "last.last_seen")
    if links is not None:
        fresh = fresh.unionByName(links.select(*fresh.columns).join(fresh.select("id", "url"), ["id", "url"], "left_anti"))
    return out.where("entity is not null").select("entity.*"), steps, fresh


_STEP = pa.struct([("id", pa.int64()), ("entity", pa.int64()), ("how", pa.string())])


def _entity_type() -> pa.DataType:
    moment, text, texts = pa.timestamp("us", tz="UTC"), pa.string(), pa.list_(pa.string())
    fact = pa.struct([*((c, text) for c in ("value", "raw", "evidence", "edition", "source_url", "confidence")), ("observed_at", moment)])
    analysis = pa.struct([("summary", text), ("suitable_for", text), ("skills", texts), ("references", pa.list_(pa.struct([(c, text) for c in ("title", "url", "evidence")])))])
    kinds = {"string": text, "timestamp": moment, "array<string>": texts, "int": pa.int32(), "boolean": pa.bool_(), ANALYSIS: analysis, f"map<string,{FACT}>": pa.map_(text, fact)}
    return pa.struct([("id", pa.int64()), *((c, kinds[kind]) for c, kind in ENTITY.items())])

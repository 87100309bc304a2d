"""Results of a model about a page: decoding, validation against the page, and merging into what rules found.

A fact is (value, evidence, edition, confidence).  It counts only if its evidence
stands in the page and it belongs to the page's edition; an event also needs evidence
that says what it claims.  Whatever is dropped is listed with its reason.

Edge cases: a null or blank fact says nothing and isn't listed; null lists are empty;
a result that isn't one strict JSON value, or of another version or kind, is refused
as a whole with its error, and its lists are empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.common import written
from tidemark.functions import markers as m
from tidemark.functions.dates import day_start, only_day_range, parse_date, registration_deadlines
from tidemark.functions.lifecycle import DATE_FIELDS, composite_status, fact_confidence
from tidemark.functions.text import contains_any, entity_key, let, normalize_ends, normalize_space
from tidemark.operators.upsert import FACT as KEPT_FACT

FACT = "struct<value:string,evidence:string,edition:string,confidence:string>"
EVENT = "struct<type:string,evidence:string,edition:string,confidence:string>"
REJECTION = "struct<field:string,reason:string,value:string>"
#: What validation tells of a result.
OUTCOME = ("error", "edition", "facts", "events", "rejections")

#: The version of results, and their kinds.
VERSION = "competition-audit-v10"
DOCUMENT_TYPES = ["listing", "official_announcement", "registration_page", "rules_document", "campus_internal", "post_event_news", "community"]
SOURCE_ROLES = ["official_primary", "official_partner", "campus_forwarding", "community"]
#: What may change an entity.
CANONICAL_TYPES = ["official_announcement", "registration_page", "rules_document"]
CANONICAL_ROLES = ["official_primary", "official_partner"]

#: The fields of a result that are facts.
IDENTITY_FIELDS = ["name", "series", "edition", "organizer", "track", "group", "scope", "region"]
FACT_FIELDS = ["published_at", "registration_start", "registration_end", "competition_start", "competition_end", "team_requirement", "fee", "eligibility", "competition_contents"]
FIELDS = ["recommendation", *(f"identity.{f}" for f in IDENTITY_FIELDS), *(f"facts.{f}" for f in FACT_FIELDS)]
#: Fields that belong to an edition, in the order of their check; the first may do without.
BOUND = ["facts.published_at", "recommendation", *(f"facts.{f}" for f in FACT_FIELDS[1:])]

#: What the evidence of an event must say (one of the first list, all of the second, none of the third).
SEMANTICS = {
    "competition_previewed": (["预告", "即将启动", "敬请期待", "预约报名", "开放报名", "启动仪式", "新一届"], [], []),
    "registration_announced": (["预告", "即将启动", "敬请期待", "预约报名", "开放报名", "启动仪式", "新一届"], [], []),
    "registration_opened": (["开始报名", "开放报名", "报名启动", "报名通道", "即日起", "现已开放", "正式开放"], ["报名"], []),
    "registration_deadline_changed": (["延期", "延长", "调整", "变更", "截止"], ["报名"], []),
    "registration_closed": (["截止", "结束", "关闭"], ["报名"], []),
    "rules_released": (["规则发布", "竞赛规程", "比赛规则", "赛事规则"], [], []),
    "problem_released": (["赛题发布", "题目发布", "赛题已发布", "赛题正式发布"], [], ["发布会"]),
    "competition_upcoming": (["即将开赛", "即将开始", "将于"], [], []),
    "competition_started": (["正式开赛", "正式开始", "今日开赛", "比赛开始"], [], []),
    "competition_finished": (["比赛结束", "赛事结束", "总决赛落幕", "总决赛闭幕"], [], []),
}
#: Reasons of rejections.
NO_EVIDENCE = "fact evidence is missing from document"
UNBOUND = "fact cannot be bound to the current edition"
OTHER_EDITION = "fact belongs to a different edition"
EVENT_TYPE = "unsupported event type"
EVENT_TWICE = "duplicate lifecycle event"
EVENT_NO_EVIDENCE = "event evidence is missing from document"
EVENT_UNBOUND = "event is not bound to the current edition"
EVENT_UNSUPPORTED = "event evidence does not explicitly support its semantics"
EVENT_STALE = "registration event is not demonstrably current"
DEADLINES = "multiple registration deadlines appear without an explicit validated deadline change"

#: Phases that events tell of, and their ranks; a closing event holds whatever came before.
REGISTRATION_PHASE = {"competition_previewed": "preview", "registration_announced": "preview", "registration_opened": "open", "registration_closed": "closed"}
COMPETITION_PHASE = {"competition_upcoming": "upcoming", "competition_started": "ongoing", "competition_finished": "finished"}
RANKS = {"unknown": 0, "preview": 10, "open": 20, "closed": 30, "upcoming": 10, "ongoing": 20, "finished": 30}
#: Days that a publication may lie ahead or back to be current.
AHEAD, BACK = 31, 370


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _looked_up(c: Column, table: dict, default=None) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), F.lit(default))


def year_in(c: Column) -> Column:
    """The first year of this or the last century as text, else ''."""
    return F.regexp_extract(_text(c), r"(?:19|20)\d{2}", 0)


def same_edition(left: Column, right: Column) -> Column:
    folded = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    years = F.struct(year_in(left).alias("a"), year_in(right).alias("b"))
    return let(years, lambda y: F.when((y["a"] != "") & (y["b"] != ""), y["a"] == y["b"]).otherwise(folded(left) == folded(right)))


def confidence(c: Column) -> Column:
    said = F.lower(normalize_ends(_text(c)))
    return F.when(said.isin("high", "medium", "low"), said).otherwise("low")


# ---- decoding


def one_value(raw: Column) -> Column:
    """The JSON value of a text that holds exactly one, as a variant; else null.

    The parser passes over what follows a value, so the value has to close both a list and an object around it.
    """
    alone = (F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1) & (F.size(F.json_object_keys(F.concat(F.lit('{"v":'), raw, F.lit("}")))) == 1)
    return F.when(alone, F.try_parse_json(raw))


def _strict(value: Column, names: list[str]) -> Column:
    """Struct of texts of an object that has no other names and no other values than texts and null; else null.

    Names may differ in case.
    """
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    own = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), F.schema_of_variant(e["value"]).alias("kind"), F.try_variant_get(e["value"], "$", "string").alias("text")))
    good = lambda es: F.forall(es, lambda e: e["key"].isin(*names) & e["kind"].isin("STRING", "VOID"))
    found = lambda es, n: F.coalesce(F.try_element_at(F.filter(es, lambda e: e["key"] == n), F.lit(1))["text"], F.lit(""))
    return let(own, lambda es: F.when(good(es), F.struct(*(found(es, n).alias(n) for n in names))))


def fact_of(value: Column) -> Column:
    """A fact from a variant: null says nothing, a text is a value without evidence, an object is strict; else null."""
    made = lambda kind: F.when(value.isNull() | (kind == "VOID"), _plain(F.lit(""))).when(kind == "STRING", _plain(F.try_variant_get(value, "$", "string"))).when(kind.startswith("OBJECT"), _strict(value, list(_PARTS)))
    return let(F.schema_of_variant(value), made)


def decode_fact(raw: Column) -> Column:
    """A fact from its JSON text; null where the text isn't one strict value."""
    return let(one_value(raw), lambda v: F.when(v.isNotNull(), fact_of(v)))


def decode(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with the result of ``raw``: its columns, ``facts`` by field, ``events``, and ``error`` where it can't be read."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    read = lambda v: let(kind(v), lambda k: F.when(k.rlike(_shape(f"(?:{_OBJECT}|VOID)")), _read_objects(v)).when(k.rlike(_shape(f"(?:{_OBJECT}|STRING|VOID)")), _read_plain(v)).otherwise(_read(v)))
    text = F.col(raw)
    typed = rows.withColumn("_objects", F.from_json(text, _typed(FACT), _PARSER)).withColumn("_whole", _says_all(text, F.col("_objects")))
    typed = typed.withColumn("_texts", F.when(~F.col("_whole"), F.from_json(text, _typed("string"), _PARSER))).withColumn("_bare", _says_all(text, F.col("_texts")))
    made = F.when(F.col("_whole"), _of_typed(F.col("_objects"), lambda f: F.struct(*(_text(f[n]).alias(n) for n in _PARTS)))).when(F.col("_bare"), _of_typed(F.col("_texts"), lambda f: _plain(_text(f)))).otherwise(let(one_value(text), read))
    names = ("error", *_TEXTS, *_FLAGS, "fit_score", "facts", "events")
    return typed.withColumn("_read", made).select(*(c for c in rows.columns if c not in names), *(F.col(f"_read.{c}").alias(c) for c in names))


#: With options of its own, so that Spark doesn't take the text itself for what is written of what was read.
_PARSER = {"mode": "PERMISSIVE"}


def _typed(fact: str) -> str:
    """Schema of a result whose facts are of the type ``fact``, in the order in which results are asked for."""
    held = lambda names: "struct<" + ",".join(f"`{n}`:{fact}" for n in names) + ">"
    fields = {**dict.fromkeys(_TEXTS[:3], "string"), **dict.fromkeys(_FLAGS, "boolean"), "fit_score": "int", "recommendation": fact, _TEXTS[3]: "string", "identity": held(IDENTITY_FIELDS), "facts": held(FACT_FIELDS), "events": f"array<{EVENT}>"}
    return "struct<" + ",".join(f"{n}:{t}" for n, t in fields.items()) + ">"


def _says_all(raw: Column, read: Column) -> Column:
    """Whether ``raw`` is strict and ``read`` all of it: written again, but for white space, it is the same text.

    Other names, repeated ones, values of other kinds and what follows a value are
    lost or changed on that way.  Nulls, which aren't written, and other orders of
    the names are left to the parser of variants.
    """
    blanks = lambda c: F.translate(c, " \t\r\n", "")
    again = F.to_json(read, {"ignoreNullFields": "true"})
    spaced = raw.rlike(r"[\[{,:]\s|\s[\]}]") & (blanks(again) == blanks(raw))
    return F.coalesce(~F.contains(raw, F.lit("null")) & ((again == raw) | spaced), F.lit(False))


def _of_typed(read: Column, fact: Callable[[Column], Column]) -> Column:
    """``_read`` of a result that ``_says_all``; facts are made by ``fact``."""
    given = [read["recommendation"], *(read["identity"][f] for f in IDENTITY_FIELDS), *(read["facts"][f] for f in FACT_FIELDS)]
    return F.struct(
        F.lit(None).cast("string").alias("error"),
        *(_text(read[t]).alias(t) for t in _TEXTS),
        *(F.coalesce(read[f], F.lit(False)).alias(f) for f in _FLAGS),
        F.coalesce(read["fit_score"], F.lit(0)).alias("fit_score"),
        F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*map(fact, given))).alias("facts"),
        F.transform(F.coalesce(read["events"], F.array().cast(f"array<{EVENT}>")), lambda e: F.struct(*(_text(e[n]).alias(n) for n in ("type", *_PARTS[1:])))).alias("events"),
    )


_TEXTS, _FLAGS = ("schema_version", "document_type", "source_role", "rejection_reason"), ("computer_related", "competition_announcement")
_PARTS = ("value", "evidence", "edition", "confidence")


def _object(fields: dict[str, str]) -> str:
    """Pattern of the schema, as the variant tells it, of an object that has no other fields than these, of these kinds.

    Objects have a name once, so the repetition is as long as the list at most.
    """
    return f"OBJECT<(?:(?:{'|'.join(f'{n}: {kind}' for n, kind in fields.items())})(?:, (?=[a-z])|(?=>)))*+>"


_OBJECT = _object(dict.fromkeys(_PARTS, "(?:STRING|VOID)"))


def _shape(fact: str) -> str:
    """Pattern of the schema of a strict result, all of whose names are in lower case and whose facts are of the kind ``fact``."""
    held = lambda names: f"(?:{_object(dict.fromkeys(names, fact))}|VOID)"
    event = _object(dict.fromkeys(["type", *_PARTS[1:]], "(?:STRING|VOID)"))
    scalars = {**dict.fromkeys(_TEXTS, "(?:STRING|VOID)"), **dict.fromkeys(_FLAGS, "(?:BOOLEAN|VOID)"), "fit_score": "(?:BIGINT|VOID)"}
    return f"^{_object({**scalars, 'recommendation': fact, 'identity': held(IDENTITY_FIELDS), 'facts': held(FACT_FIELDS), 'events': f'(?:ARRAY<(?:{event}|VOID)>|VOID)'})}$"


def _plain(text: Column) -> Column:
    """A fact that is a value without evidence."""
    return F.struct(text.alias("value"), *(F.lit("").alias(n) for n in _PARTS[1:]))


def _read_typed(v: Column, kind: str, fact: Callable[[Column], Column]) -> Column:
    """``_read`` of a variant whose schema is ``_shape``: all of it in one cast, facts as ``kind`` and made by ``fact``."""
    texts = [*_TEXTS, *(f"{f}:boolean" for f in _FLAGS)]
    schema = ",".join([t if ":" in t else f"{t}:string" for t in texts] + ["fit_score:int", f"recommendation:{kind}", f"identity:map<string,{kind}>", f"facts:map<string,{kind}>", "events:array<map<string,string>>"])
    given = lambda r: [r["recommendation"], *(F.try_element_at(r["identity"], F.lit(f)) for f in IDENTITY_FIELDS), *(F.try_element_at(r["facts"], F.lit(f)) for f in FACT_FIELDS)]
    event = lambda e: F.when(e.isNotNull(), F.struct(*(_text(F.try_element_at(e, F.lit(n))).alias(n) for n in ("type", *_PARTS[1:]))))

    def made(r: Column) -> Column:
        # an event that is null isn't strict
        ok = F.coalesce(F.forall(r["events"], lambda e: e.isNotNull()), F.lit(True))
        return let(ok, lambda ok: F.struct(
            F.when(~ok, "invalid json").alias("error"),
            *(F.when(ok, _text(r[t])).alias(t) for t in _TEXTS),
            *(F.when(ok, F.coalesce(r[t], F.lit(False))).alias(t) for t in _FLAGS),
            F.when(ok, F.coalesce(r["fit_score"], F.lit(0))).alias("fit_score"),
            F.when(ok, F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.transform(F.array(*given(r)), fact))).alias("facts"),
            F.when(ok, F.coalesce(F.transform(r["events"], event), F.array().cast(f"array<{EVENT}>"))).alias("events"),
        ))

    return let(F.try_variant_get(v, "$", f"struct<{schema}>"), made)


def _read_objects(v: Column) -> Column:
    """``_read`` of a result whose facts are objects or null."""
    return _read_typed(v, "map<string,string>", lambda m: F.struct(*(_text(F.try_element_at(m, F.lit(n))).alias(n) for n in _PARTS)))


def _read_plain(v: Column) -> Column:
    """``_read`` of a result some of whose facts are plain texts."""
    return _read_typed(v, "variant", fact_of)


def _read(v: Column) -> Column:
    """Struct of a result's columns from a variant; of nulls and an error where it isn't strict."""
    at = lambda path, kind="variant": F.try_variant_get(v, path, kind)
    keys = lambda path: F.transform(F.coalesce(F.map_keys(at(path, "map<string,variant>")), F.array().cast("array<string>")), F.lower)
    known = lambda path, names: F.forall(keys(path), lambda k: k.isin(*names))
    kinds = lambda *names: F.transform(F.array(*(at(f"$.{n}") for n in names)), lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")))
    facts = F.transform(F.array(*(F.struct(F.lit(f).alias("field"), at(f"$.{f}").alias("v")) for f in FIELDS)), lambda f: F.struct(f["field"].alias("field"), fact_of(f["v"]).alias("fact")))
    events = F.transform(F.coalesce(at("$.events", "array<variant>"), F.array().cast("array<variant>")), lambda e: _strict(e, ["type", "evidence", "edition", "confidence"]))
    good = lambda p: F.coalesce(
        F.schema_of_variant(v).startswith("OBJECT")
        & known("$", [*_TEXTS, *_FLAGS, "fit_score", "recommendation", "identity", "facts", "events"])
        & known("$.identity", IDENTITY_FIELDS) & known("$.facts", FACT_FIELDS)
        & F.forall(kinds(*_TEXTS), lambda k: k.isin("STRING", "VOID"))
        & F.forall(kinds(*_FLAGS), lambda k: k.isin("BOOLEAN", "VOID"))
        & F.forall(kinds("fit_score"), lambda k: k.isin("BIGINT", "VOID"))
        & F.forall(kinds("identity", "facts"), lambda k: F.startswith(k, F.lit("OBJECT")) | (k == "VOID"))
        & F.forall(kinds("events"), lambda k: F.startswith(k, F.lit("ARRAY")) | (k == "VOID"))
        & F.forall(p["facts"], lambda f: f["fact"].isNotNull())
        & F.forall(p["events"], lambda e: e.isNotNull()),
        F.lit(False),
    )
    whole = lambda p, ok: F.struct(
        F.when(~ok, "invalid json").alias("error"),
        *(F.when(ok, _text(at(f"$.{t}", "string"))).alias(t) for t in _TEXTS),
        *(F.when(ok, F.coalesce(at(f"$.{t}", "boolean"), F.lit(False))).alias(t) for t in _FLAGS),
        F.when(ok, F.coalesce(at("$.fit_score", "int"), F.lit(0))).alias("fit_score"),
        F.when(ok, F.map_from_entries(p["facts"])).alias("facts"),
        F.when(ok, p["events"]).alias("events"),
    )
    return let(F.struct(facts.alias("facts"), events.alias("events")), lambda p: let(good(p), lambda ok: whole(p, ok)))


# ---- validation


def classification_error(version: Column, document_type: Column, source_role: Column) -> Column:
    """Why a result is refused as a whole, else null."""
    return (
        F.when(_text(version) != VERSION, F.concat(F.lit('unsupported ai schema version "'), _text(version), F.lit('"')))
        .when(~_text(document_type).isin(*DOCUMENT_TYPES), F.concat(F.lit('invalid document_type "'), _text(document_type), F.lit('"')))
        .when(~_text(source_role).isin(*SOURCE_ROLES), F.concat(F.lit('invalid source_role "'), _text(source_role), F.lit('"')))
    )


def updates_entity(document_type: Column, source_role: Column, computer_related: Column, announcement: Column) -> Column:
    """Whether a result may change an entity."""
    return F.coalesce(announcement & computer_related & source_role.isin(*CANONICAL_ROLES) & document_type.isin(*CANONICAL_TYPES), F.lit(False))


def supported(event_type: Column, evidence: Column) -> Column:
    """Whether the evidence of an event says what its type claims."""
    out = F.lit(False)
    for name, (some, every, none) in SEMANTICS.items():
        says = contains_any(evidence, some)
        for term in every:
            says = says & F.contains(evidence, F.lit(term))
        for term in none:
            says = says & ~F.contains(evidence, F.lit(term))
        out = F.when(event_type == name, says).otherwise(out)
    return out


def is_current(edition: Column, named: list[Column], published: list[Column], now: Column) -> Column:
    """Whether a registration is of this year or later, else published not long ago."""
    years = F.filter(F.array(*(year_in(c) for c in (edition, *named))), lambda y: y != "")
    moment = F.coalesce(*(parse_date(_text(p)) for p in published))
    day = F.expr("INTERVAL 1 DAY")
    recent = (moment <= now + day * AHEAD) & (moment >= now - day * BACK)
    return F.when(F.size(years) > 0, years[0].cast("int") >= F.year(now)).otherwise(F.coalesce(recent, F.lit(False)))


def _rejected(field: Column, reason: Column, value: Column) -> Column:
    return F.struct(field.alias("field"), reason.alias("reason"), value.alias("value"))


def validate(rows: DataFrame, now: Column) -> DataFrame:
    """``rows`` (title, text, published_at_raw and a decoded result) with what holds of the result.

    ``facts`` and ``events`` become the accepted ones, ``edition`` the page's,
    ``rejections`` lists the others in the order of the checks; ``error`` also
    tells of results that are refused as a whole.

    All of it is one expression: in a chain of columns, a filter on the last would
    be pushed through all of them, and every column it reads copied at each.
    """
    refused = classification_error(F.col("schema_version"), F.col("document_type"), F.col("source_role"))
    error = F.coalesce("error", refused) if "error" in rows.columns else refused
    text = normalize_space(F.concat_ws(" ", _text(F.col("title")), _text(F.col("text"))))
    given = F.struct(error.alias("error"), text.alias("text"))
    held = rows.withColumn("_valid", let(given, lambda g: _outcome(g["error"], g["text"], now)))
    parts = {c: F.col(f"_valid.{c}") for c in ("error", "edition", "facts", "events", "rejections")}
    return held.withColumns({**parts, "fit_score": F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce("fit_score", F.lit(0))))}).drop("_valid")


def _as_fact(fact: Column, edition: Column | None = None) -> Column:
    return F.struct(fact["value"].alias("value"), fact["evidence"].alias("evidence"), (fact["edition"] if edition is None else edition).alias("edition"), fact["confidence"].alias("confidence"))


def _cleaned(given: Column, text: Column) -> Column:
    """A fact (field, fact) of the result, trimmed, and whether its evidence stands in the text."""
    trimmed = lambda f: F.struct(normalize_ends(_text(f["value"])).alias("value"), normalize_space(_text(f["evidence"])).alias("evidence"), normalize_ends(_text(f["edition"])).alias("edition"), confidence(f["confidence"]).alias("confidence"))
    there = lambda t: (t["value"] != "") & (t["evidence"] != "") & F.contains(text, t["evidence"])
    marked = lambda t: F.struct(given["field"].alias("field"), t.alias("fact"), there(t).alias("ok"), ((t["value"] != "") | (t["evidence"] != "")).alias("said"))
    return let(trimmed(given["fact"]), marked)


def _bound(field: Column, kept: Column, edition: Column) -> Column:
    """A kept fact, and what speaks against its being of the page's edition."""
    own = lambda fact: F.when(_text(fact["edition"]) != "", fact["edition"]).otherwise(year_in(fact["evidence"]))

    def judged(x: Column) -> Column:
        fact, own, free = x["fact"], x["own"], edition == ""
        reason = F.when(free, None).when((own == "") & (field != BOUND[0]), UNBOUND).when((own != "") & ~same_edition(edition, own), OTHER_EDITION)
        named = F.when(free | (own == ""), fact["edition"]).otherwise(own)
        return F.struct(field.alias("field"), _as_fact(fact, named).alias("fact"), reason.alias("reason"), own.alias("own"))

    return let(F.try_element_at(kept, field), lambda fact: let(F.struct(fact.alias("fact"), own(fact).alias("own")), judged))


def _looked_at(event: Column, text: Column, edition: Column, named: list[Column], published: Column, now: Column) -> Column:
    """An event with the reason that speaks against it, were it the first of its type."""
    trimmed = F.struct(_text(event["type"]).alias("type"), normalize_space(_text(event["evidence"])).alias("evidence"), normalize_ends(_text(event["edition"])).alias("said"), confidence(event["confidence"]).alias("confidence"))
    dated = lambda t: F.struct(t["type"].alias("type"), t["evidence"].alias("evidence"), F.when(t["said"] == "", year_in(t["evidence"])).otherwise(t["said"]).alias("edition"), t["confidence"].alias("confidence"))

    def judged(e: Column) -> Column:
        reason = (
            F.when(~e["type"].isin(*SEMANTICS), EVENT_TYPE)
            .when((e["evidence"] == "") | ~F.contains(text, e["evidence"]), EVENT_NO_EVIDENCE)
            .when((edition != "") & ((e["edition"] == "") | ~same_edition(edition, e["edition"])), EVENT_UNBOUND)
            .when(~supported(e["type"], e["evidence"]), EVENT_UNSUPPORTED)
            .when((e["type"] == "registration_opened") & ~is_current(e["edition"], named, [published, F.col("published_at_raw")], now), EVENT_STALE)
        )
        return F.struct(e.alias("event"), reason.alias("reason"))

    return let(trimmed, lambda t: let(dated(t), judged))


def _settled(looked: Column) -> Column:
    """Struct (events, rejections): of events that hold, the first of each type."""

    def step(state: Column, x: Column) -> Column:
        twice = F.exists(state["events"], lambda e: e["type"] == x["event"]["type"])
        reason = F.when(twice & (F.coalesce(x["reason"], F.lit("")) != EVENT_TYPE), EVENT_TWICE).otherwise(x["reason"])

        def placed(r: Column) -> Column:
            e = x["event"]
            field = F.when(r == EVENT_TYPE, "events").otherwise(F.concat(F.lit("events."), e["type"]))
            value = F.when(r == EVENT_TYPE, e["type"]).when(r == EVENT_TWICE, "").when(r.isin(EVENT_UNBOUND, EVENT_STALE), e["edition"]).otherwise(e["evidence"])
            return F.struct(
                F.when(r.isNull(), F.concat(state["events"], F.array(e))).otherwise(state["events"]).alias("events"),
                F.when(r.isNotNull(), F.concat(state["rejections"], F.array(_rejected(field, r, value)))).otherwise(state["rejections"]).alias("rejections"),
            )

        return let(reason, placed)

    start = F.struct(F.array().cast(f"array<{EVENT}>").alias("events"), F.array().cast(f"array<{REJECTION}>").alias("rejections"))
    return F.aggregate(looked, start, step)


def _outcome(error: Column, text: Column, now: Column) -> Column:
    """Struct (error, edition, facts, events, rejections) of a row."""
    value = lambda facts, field, c="value": _text(F.try_element_at(facts, F.lit(field))[c])
    events = F.when(error.isNull() & F.col("events").isNotNull(), F.col("events")).otherwise(F.array().cast(f"array<{EVENT}>"))

    def with_facts(facts: Column) -> Column:
        kept = F.map_from_entries(F.transform(F.filter(facts, lambda f: f["ok"]), lambda f: F.struct(f["field"], f["fact"])))
        return let(kept, lambda k: with_kept(facts, k))

    def with_kept(facts: Column, kept: Column) -> Column:
        known = F.array(value(kept, "identity.edition"), value(kept, "identity.name", "edition"), value(kept, "identity.series", "edition"), F.when(error.isNull(), year_in(F.col("title"))).otherwise(""))
        return let(_text(F.try_element_at(F.filter(known, lambda e: normalize_ends(e) != ""), F.lit(1))), lambda ed: let(F.transform(F.filter(F.array(*map(F.lit, BOUND)), lambda f: F.map_contains_key(kept, f)), lambda f: _bound(f, kept, ed)), lambda bound: with_bound(facts, kept, ed, bound)))

    def with_bound(facts: Column, kept: Column, edition: Column, bound: Column) -> Column:
        free = F.map_filter(kept, lambda k, _: ~k.isin(*BOUND))
        of_edition = F.map_from_entries(F.transform(F.filter(bound, lambda b: b["reason"].isNull()), lambda b: F.struct(b["field"], b["fact"])))
        named = [value(kept, f"identity.{f}") for f in ("edition", "name", "series")]
        looked = lambda own: F.transform(events, lambda e: _looked_at(e, text, edition, named, F.try_element_at(own, F.lit("facts.published_at"))["value"], now))
        return let(F.map_concat(free, of_edition), lambda own: let(_settled(looked(own)), lambda settled: with_events(facts, edition, bound, own, settled)))

    def with_events(facts: Column, edition: Column, bound: Column, own: Column, settled: Column) -> Column:
        end = F.try_element_at(own, F.lit("facts.registration_end"))
        moved = F.exists(settled["events"], lambda e: (e["type"] == "registration_deadline_changed") & (F.contains(e["evidence"], end["value"]) | F.contains(e["evidence"], end["evidence"])))
        unsure = F.coalesce(end.isNotNull() & (F.size(registration_deadlines(text)) > 1) & ~moved, F.lit(False))
        first = F.transform(F.filter(facts, lambda f: f["said"] & ~f["ok"]), lambda f: _rejected(f["field"], F.lit(NO_EVIDENCE), f["fact"]["value"]))
        second = F.transform(F.filter(bound, lambda b: b["reason"].isNotNull()), lambda b: _rejected(b["field"], b["reason"], F.when(b["reason"] == UNBOUND, b["fact"]["value"]).otherwise(b["own"])))
        last = lambda u: F.when(u, F.array(_rejected(F.lit("facts.registration_end"), F.lit(DEADLINES), end["value"]))).otherwise(F.array().cast(f"array<{REJECTION}>"))
        return let(unsure, lambda u: F.struct(
            error.alias("error"),
            edition.alias("edition"),
            F.map_filter(own, lambda k, _: ~(u & (k == "facts.registration_end"))).alias("facts"),
            settled["events"].alias("events"),
            F.concat(first, second, settled["rejections"], last(u)).alias("rejections"),
        ))

    # what says nothing, of which there's much, is left out before anything is made of it
    told = F.filter(F.transform(F.array(*map(F.lit, FIELDS)), lambda f: F.struct(f.alias("field"), F.try_element_at("facts", f).alias("fact"))), lambda f: (f["fact"]["value"] != "") | (f["fact"]["evidence"] != ""))
    return let(F.transform(F.when(error.isNull(), told).otherwise(F.array().cast(f"array<struct<field:string,fact:{FACT}>>")), lambda f: _cleaned(f, text)), with_facts)


# ---- results that are equal but for their score

#: What comes before the score of a result: inside of a text its quotes would be escaped.
SCORE = '"fit_score":'
#: Contents of one task.
CONTENTS_A_TASK = 5_000


def without_score(raw: Column) -> Column:
    """Struct (head, score, tail) of a result: what is written before and after its score, as both may be put around another number.

    ``score`` is null, and ``head`` all of the text, where it isn't said once, or isn't a whole number of nine digits at most.
    """
    head = F.substring_index(raw, SCORE, 1)
    rest = lambda h: F.substr(raw, F.char_length(h) + (len(SCORE) + 1))
    number = lambda r: F.when(~F.contains(r, F.lit(SCORE)), F.regexp_extract(F.left(r, F.lit(11)), r"^(-?(?:0|[1-9][0-9]{0,8}))[,}]", 1))
    cut = lambda p, n: F.when(n != "", F.struct(p["head"].alias("head"), n.cast("int").alias("score"), F.substr(p["rest"], F.char_length(n) + 1).alias("tail")))
    whole = F.struct(raw.alias("head"), F.lit(None).cast("int").alias("score"), F.lit("").alias("tail"))
    return let(F.struct(head.alias("head"), let(head, rest).alias("rest")), lambda p: F.coalesce(let(number(p["rest"]), lambda n: cut(p, n)), whole))


def validate_once(rows: DataFrame, again: Callable[[DataFrame], DataFrame], now: Column, carry: tuple[str, ...] = (), shown: Callable[[DataFrame], DataFrame] = lambda valid: valid.select("_content", "_sound", "fit_score", *OUTCOME)) -> DataFrame:
    """``rows`` (id, title, text, published_at_raw, raw) decoded and validated: id, *carry, fit_score and what is ``shown``.

    Results that are equal, but for their score, of pages that are equal are read
    once.  ``shown`` makes of what is valid of each what is told of all of its
    rows; it keeps ``_content``, ``_sound`` and ``fit_score``, and may have no row
    or several for a content.  What is shuffled of all rows is a digest; the first
    rows of each content are had ``again`` from a table of their ids.
    """
    def told(df: DataFrame) -> DataFrame:
        cut = df.withColumn("_cut", without_score(F.col("raw")))
        parts = [F.coalesce(F.sha2(c, 256), F.lit("-")) for c in (*map(F.col, ("title", "text", "published_at_raw")), F.col("_cut.head"), F.col("_cut.tail"))]
        return cut.withColumn("_content", F.unhex(F.sha2(F.concat_ws(",", *parts, F.col("_cut.score").isNull().cast("string")), 256)))

    members = written(told(rows).select("id", *carry, "_content", F.col("_cut.score").alias("_score")))
    firsts = written(members.groupBy("_content").agg(F.min("id").alias("id")).select("id"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-firsts.count() // CONTENTS_A_TASK))
    bare = F.when(F.col("_cut.score").isNotNull(), F.concat("_cut.head", F.lit(f"{SCORE}0"), "_cut.tail")).otherwise(F.col("_cut.head"))
    contents = told(again(firsts.repartition(tasks))).select("_content", "title", "text", "published_at_raw", bare.alias("raw"))
    valid = validate(decode(contents).withColumn("_sound", F.col("fit_score").isNotNull()), now)
    each = members.hint("merge").join(shown(valid), "_content")
    fit = F.when(F.col("_sound") & F.col("_score").isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), "_score"))).otherwise(F.col("fit_score"))
    return each.withColumn("fit_score", fit).drop("_content", "_score", "_sound")


# ---- phases and merging


def event_phases(events: Column, registration: Column | str = "unknown", competition: Column | str = "unknown") -> Column:
    """Struct (registration, competition, evidence): the phases that a list of events leads to.

    A phase doesn't go back, but for a closing event, which always holds.  The
    evidence is of the first event that reaches the highest state; that of the
    competition comes before that of registration.
    """
    column = lambda c: c if isinstance(c, Column) else F.lit(c)
    start = F.struct(column(registration).alias("registration"), column(competition).alias("competition"), F.lit("").alias("evidence"), F.lit(0).alias("priority"))

    def reached(now: Column, event: Column, table: dict[str, str], last: str) -> Column:
        told = _looked_up(event["type"], table)
        return F.when(told.isNotNull() & ((told == last) | (_looked_up(told, RANKS, 0) >= _looked_up(now, RANKS, 0))), told).otherwise(now)

    def step(state: Column, event: Column) -> Column:
        both = F.struct(reached(state["registration"], event, REGISTRATION_PHASE, "closed").alias("r"), reached(state["competition"], event, COMPETITION_PHASE, "finished").alias("c"))

        def ranked(p: Column) -> Column:
            priority = F.when(p["c"] != "unknown", F.lit(100) + _looked_up(p["c"], RANKS, 0)).otherwise(_looked_up(p["r"], RANKS, 0))
            higher = priority > state["priority"]
            return F.struct(p["r"].alias("registration"), p["c"].alias("competition"), F.when(higher, event["evidence"]).otherwise(state["evidence"]).alias("evidence"), F.greatest(priority, state["priority"]).alias("priority"))

        return let(both, ranked)

    return F.aggregate(F.coalesce(events, F.array().cast(f"array<{EVENT}>")), start, step, lambda s: F.struct(s["registration"].alias("registration"), s["competition"].alias("competition"), s["evidence"].alias("evidence")))


def put_fact(value: Column, evidence: Column, edition: Column, url: Column, trust: Column, published: Column, now: Column) -> Column:
    """A fact with where it comes from; null without value or evidence."""
    made = lambda v: F.struct(v.alias("value"), v.alias("raw"), normalize_space(evidence).alias("evidence"), normalize_ends(_text(edition)).alias("edition"), normalize_ends(_text(url)).alias("source_url"), fact_confidence(trust, evidence, edition, published).alias("confidence"), now.cast("timestamp").alias("observed_at"))
    return let(normalize_ends(_text(value)), lambda v: F.when((v != "") & (normalize_ends(_text(evidence)) != ""), made(v)))


def _last_told(events: Column, table: dict[str, str], phase: Column) -> Column:
    """The last event that tells of the phase; null if none does."""
    return F.try_element_at(F.filter(events, lambda e: _looked_up(e["type"], table) == phase), F.lit(-1))


def merge_model(base: DataFrame, results: DataFrame, now: Column, zone: Column | None = None) -> DataFrame:
    """``base`` (id, columns of an entity) with what valid ``results`` (id, url, published_at_raw, facts, events, fit_score) say.

    What rules found of dates, organiser, team, fee and eligibility goes; a range of
    days of the competition stays where the result has no dates of it.  Ranges that
    run backwards are cleared, a registration that hasn't begun isn't open, and one
    that is over is closed.  Adds ``accepted``, the sorted names of the facts.
    """
    zone = F.lit("UTC") if zone is None else zone
    told = results.select("id", F.col("url").alias("_url"), F.col("published_at_raw").alias("_published"), F.col("facts").alias("_facts"), F.col("events").alias("_events"), F.col("fit_score").alias("_fit"))
    both = base.join(told, "id").withColumn("_phases", event_phases(F.col("_events")))
    fact = lambda f: F.try_element_at("_facts", F.lit(f))
    value = lambda f: _text(fact(f)["value"])
    both = both.withColumns({f"_at_{d}": parse_date(value(f"facts.{d}")) for d in DATE_FIELDS})
    or_base = lambda f, c: F.when(value(f) != "", value(f)).otherwise(F.col(c))
    dates = {d: F.col(f"_at_{d}") for d in DATE_FIELDS}
    days = only_day_range(F.col("competition_start"), F.col("competition_end"), F.col("competition_start_raw"), F.col("competition_end_raw")) & dates["competition_start"].isNull() & dates["competition_end"].isNull()
    both = both.withColumn("_days", F.coalesce(days, F.lit(False)))

    put = lambda v, e, ed: put_fact(v, e, ed, F.col("_url"), F.col("trust"), F.col("_published"), now)
    stated = {"organizer": "identity.organizer"} | {f: f"facts.{f}" for f in (*FACT_FIELDS[1:], FACT_FIELDS[0])}
    entries = {k: put(fact(f)["value"], fact(f)["evidence"], fact(f)["edition"]) for k, f in stated.items()}
    old = lambda k: F.try_element_at("facts", F.lit(k))
    for k in ("competition_start", "competition_end"):
        entries[k] = F.when(F.col("_days"), F.coalesce(old(k), entries[k])).otherwise(entries[k])
    entries["published_at"] = F.coalesce(entries["published_at"], put(F.col("_published"), F.col("_published"), value("identity.edition")))
    for key, table, phase in (("registration_state", REGISTRATION_PHASE, "registration"), ("competition_state", COMPETITION_PHASE, "competition")):
        that = F.col(f"_phases.{phase}")
        last = _last_told(F.col("_events"), table, that)
        entries[key] = put(F.when(last.isNotNull(), that), last["evidence"], last["edition"])
    made = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.cast(KEPT_FACT).alias("v")) for k, v in entries.items())), lambda e: e["v"].isNotNull()))
    both = both.withColumns({
        "fit_score": F.least(F.lit(100), F.greatest(F.coalesce("fit_score", F.lit(0)), F.coalesce("_fit", F.lit(0)))),
        "fit_reason": or_base("recommendation", "fit_reason"),
        "name": or_base("identity.name", "name"),
        "organizer": value("identity.organizer"),
        "team_requirement": value("facts.team_requirement"),
        "fee": value("facts.fee"),
        "fee_evidence": F.when(value("facts.fee") != "", fact("facts.fee")["evidence"]).otherwise(""),
        "content": or_base("facts.competition_contents", "content"),
        "eligibility_note": value("facts.eligibility"),
        **{d: F.when(F.col("_days"), F.col(d)).otherwise(dates[d]) if d.startswith("competition") else dates[d] for d in DATE_FIELDS},
        **{f"{d}_raw": F.when(F.col("_days") & F.lit(d.startswith("competition")), F.col(f"{d}_raw")).when(dates[d].isNotNull(), value(f"facts.{d}")).otherwise("") for d in DATE_FIELDS},
        "facts": made,
        "registration_phase": F.col("_phases.registration"),
        "competition_phase": F.col("_phases.competition"),
        "status_evidence": F.col("_phases.evidence"),
        "problem_released": F.coalesce("problem_released", F.lit(False)) | F.exists("_events", lambda e: e["type"] == "problem_released"),
    })

    without = lambda keys: F.map_filter("facts", lambda k, _: ~k.isin(*keys))
    for kind, unsure in (("registration", F.col("registration_phase") == "open"), ("competition", F.col("competition_phase") != "unknown")):
        start, end = f"{kind}_start", f"{kind}_end"
        back = F.coalesce(F.col(end) < F.col(start), F.lit(False))
        both = both.withColumn("_back", back).withColumn("_off", F.col("_back") & unsure)
        both = both.withColumns({
            **{d: F.when(~F.col("_back"), F.col(d)) for d in (start, end)},
            **{f"{d}_raw": F.when(F.col("_back"), "").otherwise(F.col(f"{d}_raw")) for d in (start, end)},
            f"{kind}_phase": F.when(F.col("_off"), "unknown").otherwise(F.col(f"{kind}_phase")),
            "status_evidence": F.when(F.col("_off"), "").otherwise(F.col("status_evidence")),
            "facts": F.when(F.col("_off"), without((start, end, f"{kind}_state"))).when(F.col("_back"), without((start, end))).otherwise(F.col("facts")),
        })
    open_ = F.col("registration_phase") == "open"
    both = both.withColumn("_early", F.coalesce(open_ & (F.col("registration_start") > now + F.expr("INTERVAL 1 DAY")), F.lit(False)))
    both = both.withColumn("_over", F.coalesce(open_ & ~F.col("_early") & (F.col("registration_end") < day_start(now, zone)), F.lit(False)))
    closed = lambda v: F.struct(F.lit("closed").alias("value"), F.lit("closed").alias("raw"), *(v[c].alias(c) for c in ("evidence", "edition", "source_url", "confidence", "observed_at")))
    both = both.withColumns({
        "registration_phase": F.when(F.col("_early"), "unknown").when(F.col("_over"), "closed").otherwise(F.col("registration_phase")),
        "status_evidence": F.when(F.col("_early"), "").otherwise(F.col("status_evidence")),
        "facts": F.when(F.col("_early"), F.map_filter("facts", lambda k, _: k != "registration_state")).otherwise(F.transform_values("facts", lambda k, v: F.when((k == "registration_state") & F.col("_over"), closed(v)).otherwise(v))),
    })
    both = both.withColumns({"status": composite_status(F.col("registration_phase"), F.col("competition_phase")), "entity_key": entity_key(F.col("name"), F.col("organizer"), m.KEY_NOISE), "accepted": F.array_sort(F.map_keys("facts"))})
    return both.select(*base.columns, *(c for c in ("entity_key", "accepted") if c not in base.columns))


def audit(rows: DataFrame, model: str, now: Column, segments: Callable[[], Column] | None = None) -> DataFrame:
    """``rows`` (url, title, published_at_raw, text, raw, accepted, rejections) with ``audit``: what was read, taken and refused.

    ``segments`` gives a column of the texts' (id, text) structs; without it a page is one.
    """
    parts = F.array(*(_text(F.col(c)) for c in ("url", "title", "published_at_raw", "text")))
    cut = F.flatten(F.transform(segments(), lambda s: F.array(s["id"], s["text"]))) if segments else F.array().cast("array<string>")
    ids = F.transform(segments(), lambda s: s["id"]) if segments else F.array().cast("array<string>")
    said = F.struct(F.lit(VERSION).alias("analyzer_version"), F.lit(model).alias("model"), F.sha2(F.array_join(F.concat(parts, cut), "\n"), 256).alias("input_hash"), ids.alias("segment_ids"), F.array("raw").alias("raw_responses"), F.col("accepted").alias("accepted_fields"), F.col("rejections").alias("rejections"), now.cast("timestamp").alias("analyzed_at"))
    return rows.withColumn("audit", said)

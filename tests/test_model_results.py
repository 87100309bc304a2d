"""Model results about pages: decoding, validation, phases and merging, by hand."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import let, normalize_ends
from tidemark.operators import validate as v

NOW = dt.datetime(2026, 8, 4, 20)
GOOD = {"schema_version": v.VERSION, "document_type": "official_announcement", "source_role": "official_primary", "computer_related": True, "competition_announcement": True, "fit_score": 90}


def fact(value, evidence, edition="2026", confidence="high"):
    return {"value": value, "evidence": evidence, "edition": edition, "confidence": confidence}


def event(kind, evidence, edition="2026"):
    return {"type": kind, "evidence": evidence, "edition": edition, "confidence": "high"}


def validated(spark, title, text, published=None, **said):
    rows = spark.createDataFrame([(1, title, text, published, json.dumps({**GOOD, **said}))], "id long, title string, text string, published_at_raw string, raw string")
    return v.validate(v.decode(rows), F.lit(NOW)).first()


def test_facts_of_three_shapes(spark):
    raws = ["null", '"x"', ' {"value":"x","Evidence":"e","edition":null} ', '{"value":"x","more":""}', '{"value":1}', '"x" "y"', '"x"]', '"x"}', "1", "[1]", "", "nul", None, "{}", '{"value":["x"]}']
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    got = {r.i: None if r.f is None else (r.f.value, r.f.evidence, r.f.edition) for r in rows.select("i", v.decode_fact(F.col("raw")).alias("f")).collect()}
    assert [got[i] for i in range(3)] == [("", "", ""), ("x", "", ""), ("x", "e", "")] and got[13] == ("", "", "")
    assert {i for i, f in got.items() if f is None} == {3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14}


def test_results_that_are_refused(spark):
    whole = {**GOOD, "recommendation": "", "identity": {"name": None}, "facts": {}, "events": [event("rules_released", "e")]}
    raws = [whole, {**whole, "more": 1}, {**whole, "fit_score": "9"}, {**whole, "events": [{"type": 1}]}, {**whole, "identity": {"nick": "x"}}, {**whole, "identity": []}, {**whole, "facts": {"fee": 3}}, {**whole, "computer_related": "yes"}, {**whole, "schema_version": "competition-audit-v4"}, {**whole, "document_type": "something_else"}, {**whole, "source_role": ""}]
    texts = [json.dumps(r) for r in raws] + [json.dumps(whole) + " x", None, ""]
    rows = spark.createDataFrame([(i, "t", "x", None, t) for i, t in enumerate(texts)], "id int, title string, text string, published_at_raw string, raw string")
    got = {r.id: r.error for r in v.validate(v.decode(rows), F.lit(NOW)).collect()}
    assert got[0] is None and {got[i] for i in (1, 2, 3, 4, 5, 6, 7, 11, 12, 13)} == {"invalid json"}
    assert (got[8], got[9], got[10]) == ('unsupported ai schema version "competition-audit-v4"', 'invalid document_type "something_else"', 'invalid source_role ""')
    empty = v.validate(v.decode(rows.limit(0)), F.lit(NOW))
    assert empty.count() == 0


def test_what_may_change_an_entity(spark):
    kinds = spark.createDataFrame([("listing", "official_primary", True, True), ("official_announcement", "official_primary", True, True), ("rules_document", "community", True, True), ("registration_page", "official_partner", False, True), ("registration_page", "official_partner", True, None)], "d string, r string, c boolean, a boolean")
    assert [r[0] for r in kinds.select(v.updates_entity(*map(F.col, "drca"))).collect()] == [False, True, False, False, False]


def test_plain_texts_have_no_evidence(spark):
    row = validated(spark, "2026测试大赛", "赛事公告", recommendation="适合开发者", identity={"name": "2026测试大赛"}, facts={"fee": "免费"}, events=[])
    assert row.error is None and not row.facts and {r.field for r in row.rejections} == {"recommendation", "identity.name", "facts.fee"}


def test_an_old_edition_is_dropped(spark):
    row = validated(spark, "中国大学生计算机设计大赛", "2025年赛事报名通道现已开放。2026年赛事安排敬请期待。", identity={"edition": fact("2026", "2026年赛事安排敬请期待")}, events=[event("registration_opened", "2025年赛事报名通道现已开放", "2025")])
    assert row.events == [] and row.rejections[0].reason == v.EVENT_UNBOUND and row.edition == "2026"


def test_a_current_registration_without_deadline(spark):
    name = "2026 AI Agent应用创新大赛"
    row = validated(spark, name + "报名通知", name + "报名通道现已开放，报名截止时间另行通知。", identity={"name": fact(name, name), "edition": fact("2026", name)}, events=[event("registration_opened", name + "报名通道现已开放")])
    assert [e.type for e in row.events] == ["registration_opened"] and not row.rejections
    phases = spark.createDataFrame([(row.events,)], f"events array<{v.EVENT}>").select(v.event_phases(F.col("events")).alias("p")).first().p
    assert (phases.registration, phases.competition) == ("open", "unknown") and phases.evidence


def test_invented_evidence_is_dropped(spark):
    row = validated(spark, "2026云原生开发大赛", "比赛面向全国高校。", identity={"edition": fact("2026", "2026云原生开发大赛")}, facts={"fee": fact("免费", "本次比赛免收报名费")}, events=[event("registration_opened", "报名火热进行中")])
    assert "facts.fee" not in row.facts and row.events == []


def test_the_order_of_the_checks(spark):
    text = "2026年报名通道现已开放 报名截止2026年9月1日，报名截止2026年9月2日 现在开放报名 2025 赛题发布会"
    said = {
        "identity": {"edition": fact("2026", "2026年")},
        "facts": {"fee": fact("1", "现在", ""), "registration_end": fact("2026年9月1日", "2026年9月1日", ""), "eligibility": fact("x", "2025", ""), "published_at": fact("2026-08-01", "现在", "")},
        "events": [event("party", "x"), event("problem_released", "赛题发布会"), event("registration_opened", "开放报名", ""), event("registration_opened", "2026年报名通道现已开放"), event("registration_opened", "2026年报名通道现已开放"), event("registration_deadline_changed", "absent")],
    }
    row = validated(spark, "大赛", text, **said)
    assert [(r.field, r.reason) for r in row.rejections] == [
        ("facts.fee", v.UNBOUND), ("facts.eligibility", v.OTHER_EDITION),
        ("events", v.EVENT_TYPE), ("events.problem_released", v.EVENT_UNSUPPORTED), ("events.registration_opened", v.EVENT_UNBOUND), ("events.registration_opened", v.EVENT_TWICE), ("events.registration_deadline_changed", v.EVENT_NO_EVIDENCE),
        ("facts.registration_end", v.DEADLINES),
    ]
    assert set(row.facts) == {"identity.edition", "facts.published_at"} and len(row.events) == 1


@pytest.mark.parametrize(("named", "published", "raw", "held"), [("2025", "", None, False), ("", "2026-07-01", None, True), ("", "2025-01-01", "2026-07-01", False), ("", "unreadable", "2026-07-01", True), ("", "", None, False), ("", "2026-09-20", None, False)])
def test_registrations_must_be_current(spark, named, published, raw, held):
    row = validated(spark, "大赛", f"报名通道 第十届 {named} {published}", raw, identity={"name": fact(f"大赛 {named}", "大赛", "")}, facts={"published_at": fact(published, published, "")}, events=[event("registration_opened", "报名通道", "")])
    assert bool(row.events) == held


def test_phases_by_rank_and_not_by_order(spark):
    events = [event("competition_started", "比赛正式开赛"), event("registration_closed", "报名已经截止"), event("registration_opened", "报名通道现已开放")]
    for some in itertools.permutations(events):
        p = spark.createDataFrame([(list(some),)], f"events array<{v.EVENT}>").select(v.event_phases(F.col("events")).alias("p")).first().p
        assert p.competition == "ongoing" and p.registration == "closed" and p.evidence
    two = [event("registration_opened", "a"), event("competition_upcoming", "b"), event("competition_finished", "c"), event("competition_started", "d")]
    rows = spark.createDataFrame([(1, two[:2]), (2, two), (3, []), (4, None)], f"i int, events array<{v.EVENT}>")
    got = {r.i: tuple(r.p) for r in rows.select("i", v.event_phases(F.col("events")).alias("p")).collect()}
    assert got == {1: ("open", "upcoming", "b"), 2: ("open", "finished", "c"), 3: ("unknown", "unknown", ""), 4: ("unknown", "unknown", "")}


def merged(spark, said, events, **base):
    columns = {"id": 1, "name": "2026测试赛事", "organizer": "rules", "trust": "high", "content": "c", "fit_score": 5, "fit_reason": "r", "team_requirement": "t", "fee": "f", "fee_evidence": "fe", "eligibility_note": "e", "registration_phase": "open", "competition_phase": "unknown", "status": "registration_open", "status_evidence": "s", "problem_released": False}
    columns |= {k: x for d in ("registration_start", "registration_end", "competition_start", "competition_end") for k, x in ((d, None), (f"{d}_raw", ""))} | {"facts": {}} | base
    kinds = {"id": "long", "fit_score": "int", "problem_released": "boolean", "facts": f"map<string,{v.KEPT_FACT}>"} | {d: "timestamp" for d in ("registration_start", "registration_end", "competition_start", "competition_end")}
    old = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
    new = spark.createDataFrame([(1, "https://example.org/2026", None, said, events, 90)], f"id long, url string, published_at_raw string, facts map<string,{v.FACT}>, events array<{v.EVENT}>, fit_score int")
    return v.merge_model(old, new, F.lit(NOW)).first()


def test_open_before_the_start_is_unknown(spark):
    row = merged(spark, {"facts.registration_start": fact("2026年9月1日", "报名开始时间为2026年9月1日")}, [event("registration_opened", "2026年赛事报名通道现已开放")])
    assert (row.status, row.status_evidence) == ("unknown", "") and row.accepted == ["registration_start"]
    assert (row.organizer, row.fee, row.fit_score, row.content) == ("", "", 90, "c")


def test_over_is_closed_and_backwards_is_cleared(spark):
    opened = [event("registration_opened", "报名通道")]
    row = merged(spark, {"facts.registration_end": fact("2026年8月1日", "x")}, opened)
    assert row.status == "registration_closed" and row.facts["registration_state"].value == "closed" and row.facts["registration_end"].source_url == "https://example.org/2026"
    row = merged(spark, {"facts.registration_start": fact("2026年8月3日", "x"), "facts.registration_end": fact("2026年8月1日", "x"), "identity.organizer": fact("club", "club")}, opened)
    assert (row.status, row.registration_start, row.registration_end_raw, row.accepted, row.entity_key) == ("unknown", None, "", ["organizer"], "2026测试赛事club")


def test_a_range_of_days_stays(spark):
    start, end = dt.datetime(2026, 10, 25), dt.datetime(2026, 10, 26)
    kept = ("2026年10月25日", "2026年10月25日", "e", "2026", "u", "high", NOW)
    base = {"competition_start": start, "competition_start_raw": "2026年10月25日", "competition_end": end, "competition_end_raw": "26日", "facts": {"competition_start": kept, "fee": kept}}
    row = merged(spark, {}, [], **base)
    assert (row.competition_start, row.competition_end_raw, row.accepted, row.facts["competition_start"].source_url) == (start, "26日", ["competition_start"], "u")
    row = merged(spark, {"facts.competition_start": fact("2026年11月1日", "x")}, [], **base)
    assert (row.competition_start, row.competition_end, row.competition_end_raw) == (dt.datetime(2026, 11, 1), None, "")
    assert merged(spark, {}, [], **{**base, "competition_end_raw": "10月26日"}).competition_start is None


def test_audit(spark):
    rows = spark.createDataFrame([("u", "t", None, "x", "raw", ["fee"], [("f", "r", "v")])], f"url string, title string, published_at_raw string, text string, raw string, accepted array<string>, rejections array<{v.REJECTION}>")
    got = v.audit(rows, "m", F.lit(NOW)).first().audit
    other = v.audit(rows, "m", F.lit(NOW), lambda: F.array(F.struct(F.lit("s1").alias("id"), F.lit("x").alias("text")))).first().audit
    assert got.accepted_fields == ["fee"] and got.rejections[0].reason == "r" and got.raw_responses == ["raw"] and got.input_hash != other.input_hash and other.segment_ids == ["s1"]


def hostile_results(n):
    """Results of facts of all kinds, some of them not strict, some with more behind them."""
    rng = random.Random(5)
    good = [None, "x", "", {}, {"value": "x"}, fact("v", "e"), {"value": "é\n\"q", "evidence": "e", "edition": None}]
    odd = [3, True, 1.5, [], ["a"], {"Value": "u", "value": "l"}, {"value": 3}, {"value": {"a": 1}}, {"more": "x"}, {"a: STRING, value": "x"}]
    events = [event("rules_released", "e"), {}, {"type": None}]
    for _ in range(n):
        p = rng.choice([0, 0, 0.05, 0.3])
        one = lambda: rng.choice(odd if rng.random() < p else good)  # noqa: E731, B023
        said = {**GOOD, "recommendation": one(), "identity": {f: one() for f in rng.sample(v.IDENTITY_FIELDS, rng.randint(0, 8))}, "facts": {f: one() for f in rng.sample(v.FACT_FIELDS, rng.randint(0, 9))}}
        said["events"] = [rng.choice([None, "x", {"type": 1}, {"value": "x"}] if rng.random() < p else events) for _ in range(rng.randint(0, 3))]
        for k in list(said):
            if rng.random() < p / 3:
                said[k] = rng.choice([*odd, *good, 2**40, 2**70, -1])
            if rng.random() < p / 4:
                said[k.capitalize()] = said.pop(k)
        text = json.dumps(said, ensure_ascii=rng.random() < 0.5)
        yield rng.choice([text + " x", text + "]", text + "} {}", text[:-1], f"[{text}]", f" {text}\n", text[:-1] + ',"facts":{}}', text + '}, "w":[1']) if rng.random() < 0.1 else text


def test_all_at_once_or_field_by_field(spark):
    """A result of plain shape, which is decoded in one cast, reads as it does field by field."""
    rows = spark.createDataFrame(list(enumerate(hostile_results(600))), "id int, raw string")
    names = ["error", *v._TEXTS, *v._FLAGS, "fit_score", "facts", "events"]
    whole = {r.id: r.asDict() for r in v.decode(rows).select("id", *names).collect()}
    slow = {r.id: {"id": r.id, **r.r.asDict()} for r in rows.select("id", let(v.one_value(F.col("raw")), v._read).alias("r")).collect()}
    assert whole == slow and 50 < sum(r["error"] is None for r in slow.values()) < 550


def test_the_kind_of_a_value_is_asked_once(spark):
    """Each asking walks the whole value: once for the fact, once for each of its parts."""
    rows = spark.createDataFrame([('"x"',)], "raw string").select(v.decode_fact(F.col("raw")).alias("f"))
    plan = rows._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("schema_of_variant") == 2


def test_white_space_at_ends(spark):
    """Trimming takes what the pattern of white space takes, for every character of the first plane."""
    c = spark.createDataFrame([(chr(i),) for i in range(0x10000) if not 0xD800 <= i < 0xE000], "c string").select(F.concat("c", F.lit("a b"), "c", F.lit("\n"), "c").alias("t"))
    assert c.where(F.regexp_replace("t", r"(?U)^\s+|\s+$", "") != normalize_ends(F.col("t"))).count() == 0


def canonical(said):
    """A result with its names in the order in which they are asked for."""
    order = [*v._TEXTS[:3], *v._FLAGS, "fit_score", "recommendation", v._TEXTS[3], "identity", "facts", "events"]
    inner = {"identity": v.IDENTITY_FIELDS, "facts": v.FACT_FIELDS}
    return {k: {f: said[k][f] for f in inner[k] if f in said[k]} if k in inner and isinstance(said[k], dict) else said[k] for k in order if k in said} | {k: x for k, x in said.items() if k not in order}


def test_results_that_say_all_in_order(spark):
    """Those in the order of the names are read at once, odd ones aren't, and all read as they do field by field."""
    texts = []
    for raw in hostile_results(400):
        try:
            said = json.loads(raw)
        except ValueError:
            said = None
        if not isinstance(said, dict):
            texts.append(raw)
            continue
        full = {k: {f: x for f, x in e.items() if x is not None} if isinstance(e, dict) else e for k, e in canonical(said).items() if e is not None}
        texts += [json.dumps(full, ensure_ascii=False, separators=(",", ":")), json.dumps(full, ensure_ascii=False, indent=1), json.dumps(full, ensure_ascii=False)[:-1] + ',"fee ":""}', json.dumps(full, separators=(",", ":")) + " {}"]
    texts += ['{"fit_score":1,"fit_score":2}', '{"fit_score":"1"}', '{"fit_score":1099511627776}', '{"events":[null]}', '{"facts":{"fe e":{"value":"x"}}}', '{"schema_version":1}', '{"schema_version":"a\\nb"}', "[]", "1", "", "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    names = ["error", *v._TEXTS, *v._FLAGS, "fit_score", "facts", "events"]
    whole = {r.id: r.asDict() for r in v.decode(rows).select("id", *names).collect()}
    slow = {r.id: {"id": r.id, **r.r.asDict()} for r in rows.select("id", let(v.one_value(F.col("raw")), v._read).alias("r")).collect()}
    assert whole == slow
    assert rows.where(v._says_all(F.col("raw"), F.from_json("raw", v._typed(v.FACT), v._PARSER))).count() > 10


def test_equal_results_are_read_once(spark, monkeypatch):
    """Results that differ by their score alone are one content; what comes of each is what comes of it alone."""
    name = "2026测试大赛"
    said = {"recommendation": fact("适合", name), "identity": {"edition": fact("2026", name)}, "facts": {"fee": fact("x", "absent")}, "events": [event("rules_released", name)]}
    dumped = lambda **more: json.dumps({**GOOD, **said, **more}, ensure_ascii=False, separators=(",", ":"))
    scored = [dumped(fit_score=i) for i in (-7, 0, 3, 55, 100, 999_999_999, 10**10)]
    odd = [dumped(fit_score="5"), dumped(fit_score=1.5), dumped(fit_score=None), dumped(schema_version="v4"), dumped(schema_version="v4", fit_score=12), dumped(facts={"fee": fact('"fit_score":3,', name)}), dumped() + " {}", dumped()[:-1] + ',"fit_score":4}', dumped().replace(":90", ":090"), dumped().replace(":90", ":9 0"), dumped().replace(":90,", ":90}"), '{"fit_score":', "", None]
    texts = [*scored, *odd, *scored]
    rows = spark.createDataFrame([(i, name if i % 5 else "", name, None, t) for i, t in enumerate(texts)], "id long, title string, text string, published_at_raw string, raw string")
    read = []
    decode = v.decode
    monkeypatch.setattr(v, "decode", lambda df: read.append(df.count()) or decode(df))
    once = v.validate_once(rows, lambda ids: rows.join(ids, "id", "left_semi"), F.lit(NOW))
    want = v.validate(decode(rows), F.lit(NOW)).select(*once.columns)
    key = lambda r: r.id
    assert sorted(once.collect(), key=key) == sorted(want.collect(), key=key) and len(texts) == once.count()
    assert read[0] < len(texts) - 8

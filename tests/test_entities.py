"""Announcements folded into entities: cases by hand, merges in two forms, hot components."""

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from tidemark.operators import merge, resolve, upsert

NOW = dt.datetime(2026, 8, 4, 20)
SCHEMA = "id long, seen_at timestamp, source_id string, " + ", ".join(f"{c} {kind}" for c, kind in upsert.ENTITY.items())


def rows(spark, *said):
    """Announcements an hour apart; what one doesn't say is null."""
    names = ["id", "seen_at", "source_id", *upsert.ENTITY]
    plain = {"source_id": "s", "trust": "high"}
    full = [{"id": i + 1, "seen_at": NOW + dt.timedelta(hours=i), **plain, **r} for i, r in enumerate(said)]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in full], SCHEMA)


def folded(spark, *said):
    entities, steps, links = upsert.fold(rows(spark, *said))
    return sorted(entities.collect(), key=lambda r: r.id), {r.id: (r.entity, r.how) for r in steps.collect()}, links


PREVIEW = {"entity_key": "preview-key", "name": "华为ICT大赛2026-2027即将启动，敬请期待！", "organizer": "华为技术有限公司", "status": "preview", "status_evidence": "华为ICT大赛2026-2027即将启动，敬请期待", "keywords": ["云计算", "人工智能"], "analysis": ("聚焦 ICT 技术实践", None, None, None), "official_url": "https://example.huawei.com/preview"}
REGISTRATION = {"entity_key": "registration-key", "name": "关于华为ICT大赛2026-2027正式开放报名的通知", "organizer": "华为技术有限公司", "status": "registration_open", "status_evidence": "现已正式开放报名", "fee": "50元/人", "fee_evidence": "本届大赛报名费为50元/人", "registration_end": NOW + dt.timedelta(days=20), "registration_end_raw": "2026年8月24日", "competition_start": NOW + dt.timedelta(days=31), "competition_start_raw": "2026年9月4日", "official_url": "https://example.huawei.com/registration"}


def test_announcements_of_one_entity(spark):
    (one,), steps, links = folded(spark, PREVIEW, REGISTRATION)
    assert (one.id, one.status, one.fee, one.registration_end, one.competition_start) == (1, "registration_open", "50元/人", REGISTRATION["registration_end"], REGISTRATION["competition_start"])
    assert one.keywords == ["云计算", "人工智能"] and one.analysis.summary == "聚焦 ICT 技术实践" and one.entity_key == "preview-key"
    assert steps == {1: (1, "new"), 2: (1, "identity")}
    assert {(r.id, r.url) for r in links.collect()} == {(1, PREVIEW["official_url"]), (1, REGISTRATION["official_url"])}


def test_years_and_editions_are_kept_apart(spark):
    pairs = [["2026年CCF CSP认证报名通知", "2027年CCF CSP认证报名通知"], ["2026年全国大学生第十届程序设计大赛", "2026年全国大学生第十一届程序设计大赛"], ["2026 华为软件精英挑战赛", "2027 华为软件精英挑战赛"], ["第十届全国大学生云计算大赛", "第十一届全国大学生云计算大赛"]]
    said = [{"entity_key": f"k{i}", "name": n, "organizer": "中国计算机学会", "status": "registration_open", "status_evidence": "报名中", "official_url": f"https://e.org/shared{i // 2}" if i >= 4 else f"https://e.org/{i}"} for i, n in enumerate(n for p in pairs for n in p)]  # the last four use an address again
    found, steps, _ = folded(spark, *said)
    assert [r.name for r in found] == [n for p in pairs for n in p] and {how for _, how in steps.values()} == {"new"}


def test_an_address_used_again_in_a_year(spark):
    shared = {"official_url": "https://contest.example.com/notice"}
    (one,), steps, _ = folded(spark, {"entity_key": "a", "name": "2026 华为软件精英挑战赛报名预告", "status": "preview", **shared}, {"entity_key": "b", "name": "2026 华为软件精英挑战赛正式报名通知", "status": "registration_open", **shared})
    assert one.status == "registration_open" and steps[2] == (1, "url")


def test_a_newer_analyser_clears_facts_of_its_page(spark):
    base = {"entity_key": "competition-2026", "name": "2026计算机设计大赛", "official_url": "https://example.org/competition"}
    legacy = {**base, "organizer": "旧页面误提取的学院", "status": "registration_open", "status_evidence": "报名中", "registration_end": NOW, "registration_end_raw": "2026年9月4日", "fee": "100元", "fee_evidence": "报名费100元", "analyzer_version": "competition-status-v1"}
    (one,), steps, _ = folded(spark, legacy, {**base, "status": "unknown", "analyzer_version": "competition-events-v2"})
    assert (one.status, one.status_evidence, one.registration_end, one.registration_end_raw, one.fee, one.organizer) == ("unknown", "", None, "", "", "") and steps[2] == (1, "key")


def test_phases_and_facts_go_through(spark):
    fact = ("2026-09-01", None, "报名截止时间为2026年9月1日", "2026", "https://example.org/contest", "high", NOW)
    (one,), _, _ = folded(spark, {"entity_key": "facts-2026", "name": "2026 AI Agent大赛", "registration_phase": "open", "competition_phase": "upcoming", "official_url": "https://example.org/contest", "facts": {"registration_end": fact}})
    assert (one.status, one.registration_phase, one.competition_phase) == ("upcoming", "open", "upcoming")
    assert one.facts["registration_end"].evidence == "报名截止时间为2026年9月1日" and one.facts["registration_end"].observed_at == NOW


def test_address_and_trust_go_together(spark):
    first = {"entity_key": "k", "name": "spring cup of the north", "official_url": "https://a.org/", "trust": "high", "fee": "1"}
    second = {**first, "official_url": "https://b.org/", "trust": "low", "fee": "2"}
    third = {**second, "trust": "high"}
    (one,), _, _ = folded(spark, first, second)
    assert (one.official_url, one.trust, one.fee) == ("https://a.org/", "high", "1")
    (one,), _, _ = folded(spark, first, second, third)
    assert (one.official_url, one.trust, one.fee) == ("https://b.org/", "high", "")


def test_blank_keys_and_addresses_find_nothing(spark):
    found, _, links = folded(spark, {"name": "first open of the north"}, {"name": "second open of the south"}, {}, {"official_url": "", "entity_key": ""})
    assert len(found) == 4 and links.count() == 4
    assert upsert.fold(rows(spark, {}).limit(0))[0].count() == 0


def random_rows(rng, n, subjects=3):
    fee, urls = ["", "1", "2", None], ["https://a.org/", "https://b.org/", "https://c.org/"]
    names = ["spring cup of the north", "spring cup of the north 2026", "关于spring cup of the north的通知", "autumn open of the south", "第十届 autumn open of the south", "云计算挑战赛决赛安排"]
    fact = lambda: (rng.choice("xyz"), None, None, None, None, None, None)
    return [
        {
            "entity_key": f"k{rng.randrange(6)}",
            "name": rng.choice(names[: 2 * subjects]),
            "organizer": rng.choice(["", "club", "club north", "other"]),
            "status": rng.choice(["", "unknown", "preview", "registration_open", "finished"]),
            "status_evidence": rng.choice(["", "报名中", "2025 over", None]),
            "registration_phase": rng.choice(["", "unknown", "open", "closed", None]),
            "competition_phase": rng.choice(["", "unknown", "upcoming", "ongoing"]),
            "fee": rng.choice(fee),
            "fee_evidence": rng.choice(["", "e"]),
            "team_requirement": rng.choice(fee),
            "competition_end_raw": (raw := rng.choice(fee)),
            "competition_end": NOW if raw else None,
            "official_url": rng.choice(urls),
            "trust": rng.choice(["high", "medium", "low", None]),
            "analyzer_version": rng.choice(["", "v1", "v2"]),
            "keywords": rng.choice([None, [], ["A", " b", ""], ["a", "c"]]),
            "analysis": rng.choice([None, ("", None, [], None), ("s", None, None, None), (None, None, ["k"], None)]),
            "facts": rng.choice([None, {}, {"fee": fact()}, {"fee": fact(), "team_requirement": fact(), "organizer": fact()}]),
            "content": rng.choice(["", "c", None]),
            "problem_released": rng.choice([True, False]),
        }
        for _ in range(n)
    ]


def test_both_forms_of_merging_agree(spark):
    """Two announcements of one key, merged as columns and in a row."""
    rng = random.Random(4)
    pairs = [(a | {"entity_key": f"p{i}", "name": hashlib.sha256(b"%d" % i).hexdigest(), "official_url": a["official_url"] + str(i)}, b | {"entity_key": f"p{i}"}) for i, (a, b) in enumerate(zip(random_rows(rng, 300), random_rows(rng, 300), strict=True))]
    pairs = [(a, b | {"name": a["name"] + rng.choice(["", "", "通知"]), "official_url": rng.choice([a["official_url"], b["official_url"] + str(i) + "b"])}) for i, (a, b) in enumerate(pairs)]
    old, new = rows(spark, *(a for a, _ in pairs)), rows(spark, *(b for _, b in pairs))
    as_columns = merge.merge_rows(old.withColumn("last_seen", F.col("seen_at")).withColumn("first_seen", F.col("seen_at")), new.withColumn("last_seen", F.col("seen_at") + F.expr("interval 5000 hours")))
    in_a_row = upsert.fold(old.unionByName(new.withColumns({"id": F.col("id") + 1_000, "seen_at": F.col("seen_at") + F.expr("interval 5000 hours")})))[0]
    shown = [c for c in as_columns.columns]
    plain = lambda df: sorted(repr([sorted(x.items()) if isinstance(x, dict) else x for x in r]) for r in df.select(shown).collect())
    assert plain(as_columns) == plain(in_a_row)
    alone = merge.merge_rows(old, new.limit(0))
    assert alone.count() == 300


def fold_by_plain_loop(said):
    """The lookups over all entities, one announcement after the other, with the merge of the operator."""
    entities, links, steps = {}, {}, {}
    for row in said:
        by_key = [i for i, e in entities.items() if e["entity_key"] == row["entity_key"]]
        by_url = sorted(i for i, us in links.items() if row["official_url"] in us)
        found = by_key[0] if by_key else None
        if found is None and by_url and not upsert.conflict(entities[by_url[0]], row):
            found = by_url[0]
        if found is None:
            for i, e in sorted(entities.items(), key=lambda x: (-x[1]["last_seen"].timestamp(), x[0])):
                a, b = e["name_key"], row["name_key"]
                grams = [[x[k : k + 2] for k in range(len(x) - 1)] for x in (a, b)]
                shared = sum(min(grams[0].count(g), grams[1].count(g)) for g in set(grams[0]))
                value = 2 * shared / max(len(grams[0]) + len(grams[1]), 1)
                if min(len(a), len(b)) >= 6 and (a in b or b in a or value >= 0.78) and not upsert.conflict(e, row) and upsert.agree(e["organizer_key"], row["organizer_key"], value):
                    found = i
                    break
        if found is None:
            found = row["id"]
            entities[found] = row | {"last_seen": row["seen_at"], "first_seen": row["first_seen"] or row["seen_at"], "facts": dict(row["facts"] or ())}
        else:
            entities[found] = upsert.merge(entities[found], row)
        links.setdefault(found, set()).add(row["official_url"])
        steps[row["id"]] = found
    return entities, steps


def test_fold_against_a_plain_loop(spark):
    said = rows(spark, *random_rows(random.Random(1), 150))
    want, steps = fold_by_plain_loop([r.asDict(recursive=True) for r in upsert.complete(said).orderBy("seen_at", "id").collect()])
    entities, told, _ = upsert.fold(said)
    assert {r.id: r.entity for r in told.collect()} == steps
    got = {r.id: r for r in entities.collect()}
    assert set(got) == set(want) and all(got[i][c] == want[i][c] for i in got for c in ("name", "organizer", "status", "status_evidence", "fee", "official_url", "trust", "keywords"))


def test_fold_goes_on_from_an_earlier_one(spark):
    """The fold of a part, then of the rest, is the fold of all."""
    said = rows(spark, *random_rows(random.Random(3), 120))
    whole, _, links = upsert.fold(said)
    first, _, some = upsert.fold(said.where("id <= 70"))
    then, _, rest = upsert.fold(said.where("id > 70"), first, some)
    shown = lambda df: sorted(repr([sorted(x.items()) if isinstance(x, dict) else x for x in r]) for r in df.select(sorted(df.columns)).collect())
    assert shown(then) == shown(whole) and shown(rest) == shown(links)


def test_one_huge_component(spark):
    """Two thirds of all rows tell of one page; what is held is its entity."""
    n = 3_000
    base = spark.range(1, n + 1).select("id", (F.lit(NOW) + F.make_interval(secs=F.col("id"))).alias("seen_at"), F.lit("s").alias("source_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("entity_key"))
    base = base.withColumns({"name": F.when(F.col("id") % 3 > 0, "the hot spring cup").otherwise(F.sha2(F.col("id").cast("string"), 256)), "official_url": F.concat(F.lit("https://x.org/"), "entity_key"), "trust": F.lit("high")})
    entities, steps, _ = upsert.fold(base)
    assert entities.count() == n // 3 + 1 and steps.groupBy("entity").count().agg(F.max("count")).first()[0] == 2 * n // 3


def test_prefixes_lose_no_pair(spark):
    rng = random.Random(7)
    names = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 14))) for _ in range(300)})
    got = {(r.left_name, r.right_name): r.dice for r in resolve.dice_pairs(spark.createDataFrame([(n,) for n in [*names, names[0], None]], "name string"), least=0.6).collect()}

    def dice(a, b):
        grams = [[x[k : k + 2] for k in range(len(x) - 1)] for x in (a, b)]
        return round(2 * sum(min(grams[0].count(g), grams[1].count(g)) for g in set(grams[0])) / max(len(grams[0]) + len(grams[1]), 1), 6)

    assert got == {(a, b): dice(a, b) for a in names for b in names if a < b and len(a) > 1 and len(b) > 1 and dice(a, b) >= 0.6}

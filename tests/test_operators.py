"""Operators on small tables, where the fixtures don't reach a case."""

import time

from pyspark.sql import functions as F

from tidemark.operators import consensus, health, match, pages, resolve


def test_identity_of_contained_names(spark):
    names = ["spring cup", "national spring cup final 2026", "national spring cup final 2025", "spring", "a cup", "spring cap", "autumn open of the north", None]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    found = {(r.left_name, r.right_name): r.dice for r in resolve.same_identity(resolve.identity_pairs(rows)).collect()}
    own = sorted(n for n in names if n and len(n) >= 6)
    dice = {(r.left_name, r.right_name): r.dice for r in resolve.dice_pairs(rows, least=0.0).collect()}
    years = ("national spring cup final 2025", "national spring cup final 2026")
    want = {(a, b): dice[a, b] for a in own for b in own if a < b and (a, b) != years and (a in b or b in a or dice.get((a, b), 0) >= 0.78)}
    assert found == want
    assert found["national spring cup final 2026", "spring cup"] < 0.78


def test_keywords_beyond_a_thousand(spark):
    words = ["k%04d" % i for i in range(1_500)] + ["z", "yy", "zebra crossing", "!?"]
    texts = [(1, "x K0003, k1499 z"), (2, "Zebra-crossing K1 200"), (3, None), (4, ""), (5, "alias other")]
    rows = spark.createDataFrame(texts, "id long, text string")
    keywords = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = {(1, "k0003"), (1, "k1499"), (1, "z"), (2, "z"), (2, "zebra crossing"), (2, "k1200"), (5, "k1400")}
    for block in ({}, {"block_chars": 2_000}):
        found = match.keyword_match(rows, keywords, [["k1400", "other"]], "id", "text", **block)
        assert sorted((r.id, r.keyword) for r in found.collect()) == sorted(want)


def test_quotes_of_any_length(spark):
    fold = lambda x: " ".join((x or "").split())
    quotes = ["报名截止", "报名截止时间为六月一日", "open  now", "x", "one two three four", "ne two three four five", "absent", "", None, " "]
    texts = ["大赛报名截止时间为六月一日。", "it is open\nnow, one two three four five", "one two  three fours", "", None]
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")
    t = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    want = sorted((i, j) for i, a in enumerate(quotes) for j, b in enumerate(texts) if fold(a) and fold(a) in fold(b))
    assert sorted((r.quote_id, r.text_id) for r in consensus.quoted(q, t).collect()) == want and len(want) == 6


def test_quotes_in_a_long_text(spark):
    """A text is split once, not once at each of its words; that took minutes for this one."""
    words = [f"w{i % 7919}" for i in range(40_000)]
    q = spark.createDataFrame([(1, " ".join(words[30_000:30_012])), (2, "w1 w2 w3 w5 w6")], "quote_id long, quote string")
    t = spark.createDataFrame([(1, " ".join(words))], "text_id long, text string")
    began = time.monotonic()
    assert [tuple(r) for r in consensus.quoted(q, t).collect()] == [(1, 1)]
    assert time.monotonic() - began < 45


def test_equal_pages_are_read_once(spark):
    rows = spark.createDataFrame([(1, "a", "t"), (2, "a", None), (3, "a", "t"), (4, "a", None), (5, None, "t"), (6, "b", "t")], "id long, title string, text string")
    found = pages.once_each(rows, ("title", "text"), lambda r: r.withColumn("work", F.expr("uuid()"))).collect()
    assert sorted(r.id for r in found) == [1, 2, 3, 4, 5, 6]
    by = {r.id: r.work for r in found}
    assert by[1] == by[3] and by[2] == by[4] and len(set(by.values())) == 4


def plain_consensus(votes):
    """Votes of one field by a plain loop: value, edition, conflict and what was refused."""
    import re

    squash = lambda t: re.sub(r"\s", "", t or "").lower()
    groups = {}
    for value, edition, confidence, evidence in votes:
        if not (value or "").strip():
            continue
        year = re.search(r"(?:19|20)\d{2}", evidence or "")
        key = (squash(value), squash(edition) or (year[0] if year else ""))
        place = (-{"high": 3, "medium": 2}.get(confidence, 1), -len((evidence or "").encode()), evidence or "", value, edition or "")
        groups.setdefault(key, []).append(place)
    if not groups:
        return None
    top = max(map(len, groups.values()))
    shown = {k: "%s x%d" % (min(v)[3], len(v)) for k, v in groups.items()}
    first = [k for k in sorted(groups) if len(groups[k]) == top]
    if len(first) > 1:
        return (None, None, True, ", ".join(shown[k] for k in sorted(groups)))
    best = min(groups[first[0]])
    lost = ", ".join(sorted(shown[k] for k in groups if k != first[0])) if len(groups) > 1 and top < len(votes) else None
    return (best[3], best[4] or first[0][1], False, lost)


def test_fact_consensus(spark):
    import random

    rng = random.Random(9)
    docs = {}
    for d in range(60):
        docs[d] = [(rng.choice(["A b", "ab", "C", "", None, " "]), rng.choice(["", "2026", None]), rng.choice(["high", "medium", "low", "?"]), rng.choice(["in 2026", "in 2025 here", "plain", None])) for _ in range(rng.randrange(1, 7))]
    rows = [(d, "facts.registration_end", *v) for d, votes in docs.items() for v in votes]
    facts = consensus.fact_consensus(spark.createDataFrame(rows, "doc long, field string, value string, edition string, confidence string, evidence string"))
    got = {r.doc: (r.value, r.edition, r.conflict, r.refused) for r in facts.collect()}
    want = {d: plain_consensus(v) for d, v in docs.items()}
    assert got == {d: w for d, w in want.items() if w is not None}
    torn = {d for d, w in got.items() if w[2]}
    assert torn and {r.doc for r in consensus.withhold_lifecycle(facts).collect()} == set(got) - torn


def test_alerts_remember_the_last_one(spark):
    """Three failures alert, the same count again doesn't, and after a success three more do."""
    rows = lambda *x: spark.createDataFrame([("s", i, k) for i, k in x] + [("t", 1, 4)], "source string, at int, streak long")
    first = rows((1, 1), (2, 2), (3, 3))
    shown = lambda df: sorted((r.source, r.at) for r in df.collect())
    assert shown(health.alerts(first, "source", ["at"], 3)) == [("s", 3), ("t", 1)]
    told = health.alerted_counts(first, "source", ["at"], 3)
    assert shown(health.alerts(rows((4, 3)), "source", ["at"], 3, alerted=told)) == []
    assert shown(health.alerts(rows((4, 4)), "source", ["at"], 3, alerted=told)) == [("s", 4)]
    again = rows((4, 0), (5, 1), (6, 2), (7, 3))
    assert shown(health.alerts(again, "source", ["at"], 3, alerted=told)) == [("s", 7)]
    assert sorted(map(tuple, health.alerted_counts(rows((4, 0)), "source", ["at"], 3, told).collect())) == [("t", 4)]

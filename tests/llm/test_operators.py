"""Each operator against a brute-force version on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, differences
from tidemark.llm import boosted_trees, decontaminate, line_spread, order_minhash, page_text, quality_rules, queries, source_mix, suffix_dedup, token_counts, toxic_spans, weak_quality

def removed_by_brute_force(texts: list[bytes]) -> list[tuple[int, int, str]]:
    """Removed bytes, spans and digest of texts in document order, window by window."""
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - suffix_dedup.LENGTH + 1):
            w = t[i : i + suffix_dedup.LENGTH]
            if w in seen:
                gone[i : i + suffix_dedup.LENGTH] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        out.append((int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return out


DOCS = "doc_id long, text string, lang string, source string, group_id string"


def frame(spark, texts, ids=None):
    """``documents`` with nulls, and a column whose name clashes with a result's."""
    rows = [((ids or range(len(texts)))[i], t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s3"][i % 4], "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "rho", "Été", "mu", "nu"]) for _ in range(900)]
    out = [None, "", " \n ", "one", "a" * 99, "a" * 100, "a" * 260]
    for i in range(25):
        a = rng.randrange(700)
        out.append(" ".join(base[a : a + rng.randrange(5, 90)]) + "".join(rng.choice("xyz\n ") for _ in range(30)))
    return [*out, out[12], out[12], " ".join(base * 4)]


def test_suffix_dedup(spark, texts, monkeypatch):
    for hot, orders in ((1 << 20, 3), (400, 1), (400, 3)):
        monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4_000)
        monkeypatch.setattr(suffix_dedup, "ORDERS", orders)
        monkeypatch.setattr(suffix_dedup, "SECTION_BYTES", 700)
        found = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
        want = removed_by_brute_force([(t or "").encode() for t in texts])
        got = [(found[i].n_removed, found[i].n_spans, hashlib.sha256(bytes(found[i].kept)).hexdigest()) for i in range(len(texts))]
        assert got == want


def test_suffix_dedup_of_repeated_ids(spark):
    same = "".join(chr(97 + i % 23 * i % 26) for i in range(150))
    rows = suffix_dedup.remove_repeats(frame(spark, [same, same, "other " + same, same], [1, 1, 1, None])).collect()
    assert len(rows) == 4
    assert sorted(r.n_removed for r in rows if r.doc_id is None) == [0]
    assert {r.n_removed for r in rows if r.doc_id == 1} == {150}


@pytest.mark.parametrize("hot, orders", [(1 << 20, 3), (400, 1), (400, 3)])
def test_suffix_dedup_of_periods(spark, monkeypatch, hot, orders):
    """Texts that repeat inside themselves only, down to one window more than a period."""
    rng = random.Random(8)
    unit = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    ring = lambda u, n: (u * (n // len(u) + 1))[:n]
    twice = ring(unit(31), 300)
    texts = ["Lorem ipsum dolor sit amet. " * 20, twice, twice]
    texts += [ring(unit(p), 100 + p + more) for p in (1, 2, 5, 24, 27, 50, 76, 77, 78, 99, 100, 130) for more in (-1, 0, 1, 90)]
    texts += [unit(90) + ring(unit(p), 100 + p + 3) + unit(90) for p in (3, 40, 77, 90)]
    for name, value in (("HOT_BYTES", hot), ("BLOCK_BYTES", 4_000), ("ORDERS", orders)):
        monkeypatch.setattr(suffix_dedup, name, value)
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    got = [(found[i].n_removed, found[i].n_spans, hashlib.sha256(bytes(found[i].kept)).hexdigest()) for i in range(len(texts))]
    assert got == removed_by_brute_force([t.encode() for t in texts])
    assert found[0].n_removed == 532 and min(found[1].n_removed, found[2].n_removed) > 0


def test_suffix_dedup_rows_of_sf01(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    want = {i: w for (i, _), w in zip(texts, removed_by_brute_force([t for _, t in texts]), strict=True)}
    got = {r.doc_id: (r.n_removed, r.n_spans, r.sha) for r in suffix_dedup.remove_repeats(docs).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).collect()}
    assert got == want


def test_intervals():
    rng = np.random.default_rng(1)
    for _ in range(60):
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(1, 200))).astype(np.uint8)
        length = int(rng.integers(1, 30))
        order, shared = suffix_dedup.backward_intervals(data, length)
        ring = np.concatenate([data] * (length // len(data) + 2)).tobytes()
        heads = [ring[i : i + length] for i in order]
        assert heads == sorted(heads)
        assert shared.tolist() == [False, *(a == b for a, b in zip(heads[1:], heads, strict=False))]


def test_decontamination(spark, texts):
    items = [("i1", " ".join(texts[10].split()[2:20])), ("i2", "ONE"), ("i3", None), ("i4", "?!"), ("i5", texts[12])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for item, text in items:
        own = low(text)
        size = min(10, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[k : k + size]), set()).add(item)
    for block_words in (2_000_000, 15):
        found = decontaminate.find_contamination(frame(spark, texts), bench, block_words)
        for r in found.collect():
            own, hit, names = low(r.text), set(), set()
            for gram, holders in windows.items():
                for k in range(len(own) - len(gram) + 1):
                    if tuple(own[k : k + len(gram)]) == gram:
                        hit.update(range(k, k + len(gram)))
                        names |= holders
            assert (r.n_words, r.n_hit, r["items"]) == (len(own), len(hit), sorted(names))


def test_quality_statistics(spark, texts):
    docs = frame(spark, [*texts, "a b c d e f g h i j " * 5 + "# x\nx\nx\n\n\n"])
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r in quality_rules.judge_quality(docs, None).collect():
        own = word.findall(r.text or "")
        count = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
        inside = {j for i in range(len(own) - 7) if count[tuple(own[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if word.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(own), sum(map(len, own)), len(inside))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or "")) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(own) < 20 or 100 * len(inside) > 30 * len(own))


def test_trees_are_monotone():
    rng = np.random.default_rng(3)
    x = rng.random((600, 2))
    y = (x[:, 0] + 0.3 * rng.random(600) < 0.6).astype(float)
    model = boosted_trees.fit(x, y, np.array([-1, 0]))
    grid = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.4)])
    assert (np.diff(model.score(grid)) <= 1e-12).all()
    assert boosted_trees.fit(x, np.ones(600), np.array([0, 0])) is None


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = ["w%d" % rng.randrange(4000) for _ in range(1200)]
    texts = [None, "", "one two", "One two!"]
    for i in range(12):
        own = base[i * 90 : i * 90 + rng.choice([8, 12, 30, 80])]
        texts += [" ".join(own), " ".join([*own, "end"])]
        for _ in range(3):
            other = list(own)
            other[rng.randrange(len(other))] = "zz"
            texts.append(" ".join(other))
    shingles = [order_minhash.shingle_list(decontaminate.normal_words(t)) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, a in enumerate(shingles):
        for j in range(i):
            b = shingles[j]
            if a and (a == b or min(len(a), len(b)) > 1 and order_minhash.similarity(a, b) >= 0.8):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    got = {r.doc_id: r.group_id for r in order_minhash.with_groups(frame(spark, texts)).collect()}
    assert got == {i: top(i) for i in range(len(texts))}
    kept = order_minhash.keep_one_of_each(frame(spark, texts))
    assert kept.count() == len(set(got.values())) and kept.columns == ["doc_id", "text", "lang", "source", "group_id"]


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.82: common words, then own words of each text."""
    rng, words = random.Random(80), iter(range(10**9))
    fresh = lambda n: ["w%d" % next(words) for _ in range(n)]

    def pair(common, left, right):
        own = fresh(common + 4)
        a, b = own + fresh(left), own + fresh(right)
        return (a, b) if rng.random() < 0.5 else (a[::-1], b[::-1])

    encoded = lambda own: [w.encode() for w in own]
    for common, left, right in ((16, 2, 2), (16, 0, 4), (13, 0, 3), (20, 0, 5), (40, 5, 5), (41, 0, 9), (80, 10, 10)):
        pairs = [pair(common, left, right) for _ in range(1000)]
        shingles = [order_minhash.shingle_list(encoded(x)) for x in pairs[0]]
        assert 0.8 <= order_minhash.similarity(*shingles) < 0.825
        sketches = [[order_minhash.order_sketches(encoded(x)) for x in both] for both in pairs]
        lost = sum(not any(x is not None and x == y for x, y in zip(a, b, strict=False)) for a, b in sketches)
        assert lost == 0, (common, left, right)
    texts = [" ".join(x) for _ in range(300) for x in pair(16, 2, 2)]
    got = {r.doc_id: r.group_id for r in order_minhash.with_groups(frame(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_line_spread(spark):
    docs = frame(spark, ["same line\nown %d\nsame line" % i for i in range(8)] + [None, "", "same line"])
    out = {r.doc_id: r for r in line_spread.remove_boilerplate(docs, 4).collect()}
    assert out[0].text == "same line\nown 0" and out[3].text == "own 3" and out[10].text == "" and out[8].text is None
    assert {r.n_removed for r in line_spread.remove_boilerplate(docs, 5).collect()} == {0}


def test_source_mix_budgets(spark, texts):
    docs = frame(spark, texts)
    mixed = source_mix.mix(docs, F.col("source"), {"domain": {"s1": 3, "s2": 0}}, budget=300).collect()
    assert sum(r.n_tokens for r in mixed) <= 300 and "s2" not in {r.domain for r in mixed}
    assert source_mix.mix(docs.limit(0), F.col("source"), {}, budget=10).count() == 0


def test_token_counts(spark, texts):
    load = token_counts.TokenizerFile("byte_bpe_50k.json")
    tokenizer = load()
    for r in token_counts.count_tokens(frame(spark, [*texts, "a<|endoftext|>b 　 c", "x \t y\r\n"])).collect():
        assert r.n_tokens == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)


def test_page_text(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy</div><article><h1>Head</h1><p>One &amp; two\n three, a line that is long enough to speak.<p>Next</article><footer>f</footer></body></html>"
    rows = spark.createDataFrame([(1, "http://a.b/x", page), (2, None, None), (3, "bad", "")], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in page_text.extract_main_text(rows).collect()}
    assert out == {1: "Head\n\nOne & two three, a line that is long enough to speak.\n\nNext", 2: "", 3: ""}


WRAPPERS = ['<div style="overflow:hidden">', '<div aria-hidden="false">', '<div title="a hidden gem">', '<div data-role="banner">', '<div data-id="ad">', '<div class="two-side-layout">', '<div class="side page">', "<form id=aspnet>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_page_in_a_wrapper(wrapper):
    article = "<article><h1>Head</h1><p>One &amp; two\n three, a line that is long enough to speak for it.<p>Next</article>"
    noise = "<p>words and words and words and words and words and even more words</p>"
    left_out = "".join(f"<{t}>{noise}</{t.split()[0]}>" for t in ("nav", "aside", "div class='comment-list'", "div hidden", "div role=banner", "section class='site-notice'", "div id=ad-top", "select", "script"))
    page = f"<html><body>{wrapper}{left_out}{article}<div><h3>3 Comments</h3>{noise}</div></div></body></html>"
    assert page_text.main_text(page, None) == "Head\n\nOne & two three, a line that is long enough to speak for it.\n\nNext"


def test_short_article_beside_a_long_advert():
    page = "<body><div class='ad'>" + "buy " * 50 + "</div><article><h1>Short</h1><p>Text</article></body>"
    assert page_text.main_text(page, None) == "Short\n\nText"


def test_hostile_pages():
    """Time in proportion to the page: these end at once, or not in the life of a task."""
    words = "a text of more than forty characters, which speaks for its container"
    assert page_text.main_text("<div>" * 100_000 + f"<p>{words}" + "</p>" * 1_000, None) == words
    assert page_text.main_text("<a " * 200_000, None) == " ".join(["<a"] * 200_000)
    assert page_text.main_text("<p>abc<script>x", None) == page_text.main_text("<p>abc<!-- x", None) == "abc"


def test_learnt_scores(spark):
    """On the larger tables: the smaller ones hold out fewer than ten toxic rows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    tox = toxic_spans.score_toxicity(docs, toxic_spans.train(docs, labels, wanted=lambda c: ~toxic_spans.held_out(c)))
    held = tox.join(labels, "doc_id").where(toxic_spans.held_out(F.col("doc_id"))).select("toxic", "score").toPandas()
    good = weak_quality.classify(docs, weak_quality.train(docs)).join(labels, "doc_id").select("quality", "score").toPandas()
    for table, label in ((held, "toxic"), (good, "quality")):
        one, zero = (table.score[table[label] == k].to_numpy() for k in (1, 0))
        assert (one[:, None] > zero[None, :]).mean() > 0.85


CLASHING = "key row id version text2 n_words n_hit items hit_spans hits found s n n_votes posterior score kept stats vote_pipes n_lines n_removed gone group_id is_first copies root node domain epoch n_tokens n_tokens_before bucket hash start spans predicted n_bytes over_limit removed_spans n_spans n_chars own path host url html base_failed word_chars a.b".split()


@pytest.fixture(scope="module")
def nasty(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and columns named like results and helpers."""
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(rng.randrange(999)) for _ in range(150_000))
    plain = ["the quick brown fox number %d jumps over a lazy dog and runs home again at night when all is calm %d" % (i, i) for i in range(6)]
    texts = [None, "", " ", long, "x" * 300_000, plain[0], plain[0], *plain, "a\nb\n" * 4]
    rows = [(None if i == 4 else 7 if i in (5, 6) else i, t, None if i % 3 else "en", None if i % 4 else "s1") for i, t in enumerate([*texts, texts[-2]])]
    rows += [rows[-1], (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("mine"))
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(12)] + [(None, 1, None), (3, None, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, plain[1]), ("i", plain[1]), ("j", None), ("k", "alpha1")], "item_id string, text string")
    return docs, labels, bench


OPERATORS = {
    "op1": (lambda d, l, b: suffix_dedup.remove_repeats(d), ["n_bytes", "n_removed", "n_spans", "removed_spans", "kept"]),
    "op2": (lambda d, l, b: decontaminate.find_contamination(d, b), ["n_words", "n_hit", "items", "hit_spans"]),
    "op2 in blocks": (lambda d, l, b: decontaminate.find_contamination(d, b, 12), ["n_words", "n_hit", "items", "hit_spans"]),
    "op2 spans": (lambda d, l, b: decontaminate.remove_spans(d, b), []),
    "op3": (lambda d, l, b: weak_quality.classify(d, weak_quality.train(d)), ["n_votes", "posterior", "score", "kept"]),
    "op4": (lambda d, l, b: order_minhash.with_groups(d), ["group_id", "is_first"]),
    "op5": (lambda d, l, b: toxic_spans.score_toxicity(d, toxic_spans.train(d, l)), ["score", "predicted", "spans"]),
    "op6": (lambda d, l, b: source_mix.mix(d, F.col("domain"), {}, share=1.0, max_epochs=1), ["domain", "epoch", "n_tokens", "n_tokens_before"]),
    "op7": (lambda d, l, b: page_text.extract_main_text(d, "source", "text"), ["text", "n_chars"]),
    "op8": (lambda d, l, b: line_spread.remove_boilerplate(d, 2), ["n_lines", "n_removed"]),
    "op9": (lambda d, l, b: quality_rules.judge_quality(d, quality_rules.train(d, l)), [*quality_rules.COLUMNS, "score", "base_failed", "kept"]),
    "op10": (lambda d, l, b: token_counts.count_tokens(d), ["n_bytes", "n_tokens", "over_limit"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_rows(spark, nasty, name):
    """No row is lost, no column of the input changes but those that are results, and equal rows agree."""
    docs, labels, bench = nasty
    operator, results = OPERATORS[name]
    out = operator(docs, labels, bench)
    assert out.columns == [c for c in docs.columns if c not in results] + results
    rows = out.withColumn("text", F.col("text")).collect()
    assert len(rows) == docs.count()
    own = [c for c in CLASHING if c not in results]
    assert {r[c] for r in rows for c in own} == {"mine"}
    if "text" not in results and name not in ("op8", "op2 spans"):
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    none = operator(docs.limit(0), labels.limit(0), bench.limit(0))
    assert none.columns == out.columns and none.count() == 0


def test_decontamination_in_blocks(spark, nasty):
    docs, _, bench = nasty
    bench = bench.unionByName(spark.createDataFrame([("long", docs.where("doc_id = 3").first().text[:2_000])], "item_id string, text string"))
    one, many = ({(r.doc_id, r.text): (r.n_words, r.n_hit, r["items"], r.hit_spans) for r in decontaminate.find_contamination(docs, bench, k).collect()} for k in (10**6, 30))
    assert one == many
    assert sum(bool(v[2]) for v in one.values()) >= 3 and ([None, "i"] in [v[2] for v in one.values()])
    kept = decontaminate.remove_spans(spark.createDataFrame([(1, "Start, alpha1! end")], "doc_id long, text string"), bench)
    assert kept.first().text == "Start, ! end"


def test_kept_documents_keep_their_columns(spark, nasty):
    docs, _, bench = nasty
    for out in (order_minhash.keep_one_of_each(docs), decontaminate.remove_documents(docs, bench)):
        assert out.columns == docs.columns and {r.group_id for r in out.collect()} == {"mine"}


def test_lines_of_a_long_document(spark):
    """Half of very many lines go; the time is in proportion to them."""
    text = "\n".join("l%d" % (i % 2 * i) for i in range(200_001))
    docs = spark.createDataFrame([(1, text, "a"), (2, "l0", "b")], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in line_spread.remove_boilerplate(docs, 2).collect()}
    assert out[1].n_removed == 100_000 and out[1].text == "\n".join(["l0", *("l%d" % i for i in range(1, 200_001, 2))]) and out[2].text == ""


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    assert differences(spark, connect(), queries.QUERIES[name], queries.ORACLES[name]) == ""


def test_prefix_pairs_lose_none(spark):
    """Texts that share a long passage, near copies of one text and lone ones: all pairs at the threshold, by a plain loop."""
    rng = random.Random(11)
    fresh = lambda n, tag: ["%s%d" % (tag, rng.randrange(10**6)) for _ in range(n)]
    passage, base = fresh(60, "p"), fresh(50, "b")
    texts = [passage + fresh(n, "o") for n in (2, 4, 5, 6, 8, 10, 12, 15, 20, 40) for _ in range(3)]
    for _ in range(25):
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(50)] = "z%d" % rng.randrange(10**6)
        texts.append(own[: rng.randrange(44, 51)])
    texts += [fresh(30, "l") for _ in range(5)] + [["la"] * n for n in (9, 10, 12, 14)]
    encoded = [[w.encode() for w in t] for t in texts]
    shingles = [order_minhash.shingle_list(t) for t in encoded]
    for roots in (list(range(len(texts))), [0 if 30 <= i < 50 else i for i in range(len(texts))]):
        rows = [(i, len(shingles[i]), roots[i], int(h)) for i, t in enumerate(encoded) for h in order_minhash.labelled_shingles(t).view(np.int64)]
        found = order_minhash.prefix_pairs(spark.createDataFrame(rows, "node long, n int, root long, token long"), 0.8).collect()
        got = {tuple(sorted((r.x, r.y))) for r in found}
        want = {(i, j) for j in range(len(texts)) for i in range(j) if roots[i] != roots[j] and order_minhash.similarity(shingles[i], shingles[j]) >= 0.8}
        assert len(got) == len(found) and want <= got
        assert len(got) < 3 * len(want)


@pytest.mark.parametrize("inner", ['<section class="social-history">', '<div class="search-engines">', '<section id="related-work">', '<section id="form-factors">', '<p id="notice">', '<div class="advert-free">'])
def test_article_parts_of_unlucky_names(inner):
    """A name that holds one word of a menu or a notice beside a subject leaves nothing out."""
    said = "This sentence of the article is long enough to speak for its container. "
    tag = inner[1:].split()[0]
    page = f"<body><nav>Home News</nav><article><h1>Title</h1><p>{said * 2}</p>{inner}Inner {said}</{tag}></article><div class='cookie-notice'>We use {said}</div><ul class='social-links'><li>Share {said}</li></ul></body>"
    assert page_text.main_text(page, None).split("\n\n") == ["Title", (said * 2).strip(), f"Inner {said}".strip()]


def test_page_of_short_blocks():
    assert page_text.main_text("<body><div>Short one.</div><div>Short two.</div></body>", None) == "Short one.\n\nShort two."
    assert page_text.main_text("<body><nav>Home</nav><div>A</div><table><tr><td>B</td><td>C</td></tr></table><footer>end</footer></body>", None) == "A\n\nB\n\nC"


def test_generated_pages():
    """Articles with known text among menus, notices, adverts and comments, in several arrangements."""
    rng = random.Random(6)
    names = ["social-history", "search-engines", "form-factors", "related-work", "notice-of-meeting", "promotion-rules", "menu-planning", "comment-on-rulings", ""]
    for _ in range(400):
        words = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "and", "of"]) for _ in range(k))
        blocks = [words(rng.choice([3, 12, 30])) for _ in range(rng.randrange(2, 7))]
        inner = "".join(rng.choice(["<p>%s</p>", f'<section class="{rng.choice(names)}"><p>%s</p></section>', '<p id="notice">%s</p>', "<h2>%s</h2>"]) % b for b in blocks)
        body = f"<article>{inner}</article>" if rng.random() < 0.6 else f'<div class="post-content">{inner}</div>'
        noise = [f"<nav>{words(9)}</nav>", f'<div class="ad-box">{words(40)}</div>', f'<aside>{words(30)}</aside>', f'<div id="cookie-banner">{words(20)}</div>', f'<div class="comments"><p>{words(25)}</p></div>', f"<footer>{words(12)}</footer>"]
        page = f"<html><body>{noise[0]}{noise[1]}{body}{''.join(rng.sample(noise[2:], 3))}</body></html>"
        assert page_text.main_text(page, None) == "\n\n".join(blocks), page

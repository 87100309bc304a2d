"""Embedding links, cross-tokenizer alignment and whitening against plain versions on small tables."""

import hashlib
import math
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, token_alignment, vector_links, whitening

CLASHING = "key row id node digest dim body side least weight bucket root name links n p deviation whitened explained identity_error unit cuts sha groups n_a n_b n_groups n_links n_best n_best_a count_sum groups_sha256 component_id kept v text2 a.b".split()
VECTORS = "vec_id long, embedding array<float>, label int"


def clashing(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit("mine"))
    return df


def cosine(a, b):
    a, b = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)


def links_by_brute_force(rows, threshold=vector_links.THRESHOLD):
    """(links, component) of each row by all pairs."""
    ok = lambda i, j: rows[i][2] is not None and rows[i][2] == rows[j][2] and usable(rows[i][1]) and usable(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= threshold
    near = [[j for j in range(len(rows)) if j != i and ok(i, j)] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(rows))]
    names = defaultdict(list)
    for i, r in enumerate(root):
        names[r].append(rows[i][0])
    name = {r: min((x for x in ids if x is not None), default=None) for r, ids in names.items()}
    return [(rows[i][0], len(near[i]), name[root[i]]) for i in range(len(rows))]


def at_cosine(rng, u, c):
    """A vector at cosine ``c`` to ``u``."""
    w = rng.standard_normal(len(u))
    w -= w @ u / (u @ u) * u
    return c * u / np.linalg.norm(u) + math.sqrt(1 - c * c) * w / np.linalg.norm(w)


@pytest.fixture(scope="module")
def hard_vectors():
    rng = np.random.default_rng(3)
    rows = [(None, None, None), (1, None, 0), (2, [], 0), (3, [0.0] * 16, 0), (4, [float("nan")] * 16, 0), (5, [1.0] * 15 + [float("inf")], 0), (6, [None] + [1.0] * 15, 0), (7, [1.0] * 16, None), (8, [1.0] * 15, 0)]
    centre = rng.standard_normal(16)
    for i in range(40):  # a tight group of one label, its like under another, and copies
        rows.append((100 + i, (at_cosine(rng, centre, 0.99) * (i + 1)).tolist(), i % 7 // 6))
    rows += [rows[-1], rows[-1], (None, rows[-1][1], 0), (300, rows[-2][1], 0), (300, rows[-3][1], 0)]
    last = rng.standard_normal(16)
    for i in range(8):  # a chain: neighbours are links, others aren't
        rows.append((50 - i, last.tolist(), 2))
        last = at_cosine(rng, last, 0.94)
    for i in range(60):
        rows.append((1_000 + i, rng.standard_normal(16).tolist(), i % 3))
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], s) for i, v, s in rows]


@pytest.mark.parametrize("part", [8, 1_024])
def test_vector_links(spark, hard_vectors, monkeypatch, part):
    monkeypatch.setattr(vector_links, "PART", part)
    docs = clashing(spark.createDataFrame(hard_vectors, VECTORS).repartition(3))
    out = vector_links.with_links(docs)
    added = ["n_links", "component_id", "kept"]
    assert out.columns == [c for c in docs.columns if c not in added] + added
    got = out.collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(links_by_brute_force(hard_vectors))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and {r["a.b"] for r in got} == {"mine"}
    assert vector_links.with_links(docs.limit(0)).count() == 0


def test_vector_links_at_the_threshold(spark):
    """Pairs just over the threshold are found, pairs just under it aren't."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        u = rng.standard_normal(64)
        rows += [(4 * i, u.tolist(), 0), (4 * i + 1, at_cosine(rng, u, 0.9301 + i % 5 * 0.001).tolist(), 0)]
        rows += [(4 * i + 2, (w := rng.standard_normal(64)).tolist(), 1), (4 * i + 3, at_cosine(rng, w, 0.9299).tolist(), 1)]
    got = {r.vec_id: r.n_links for r in vector_links.with_links(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()}
    assert sum(got[4 * i] + got[4 * i + 1] for i in range(400)) == 800
    assert not any(got[4 * i + 2] or got[4 * i + 3] for i in range(400))


def test_chances_of_meeting():
    rng = np.random.default_rng(1)
    for distance in (0.374, 1.41):
        x = rng.standard_normal(200_000) * distance
        shift = rng.random(200_000) * vector_links.WIDTH
        met = (np.floor((x + shift) / vector_links.WIDTH) == 0).mean()
        assert abs(met - vector_links.collision(distance)) < 0.005
    for rows in (0, 1, 50, 10**6):
        k, tables = vector_links.plan_tables(rows)
        assert (1 - vector_links.collision(math.sqrt(0.14)) ** k) ** tables <= vector_links.MISS


def test_one_row_each_of_a_hot_group(spark, monkeypatch):
    """What the comparison of a group of near copies returns is in proportion to its rows."""
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(32)
    rows = [(i, at_cosine(rng, centre, 0.995).tolist(), 0) for i in range(600)]
    nodes = vector_links.node_rows(spark.createDataFrame([((i, v, s),) for i, v, s in rows], f"row struct<{VECTORS}>"), "embedding", "label")
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), F.lit(5).cast("long").alias("side"), "node.dim", "node.body", F.lit(1).cast("long").alias("weight"))
    counts, edges = vector_links.link_counts(vector_links.written(nodes), 0.93, 1e-4, 1)
    assert counts.agg(F.min("links"), F.max("links")).first() == (599, 599)
    assert edges.count() < 20 * 600


def alignment_by_brute_force(texts):
    """The contract's columns by whole texts, one after the other."""
    tokens = token_alignment.Tokens("byte_bpe_50k.json", "piece_bpe_32k.model")
    rows, pairs = [], []
    for text in texts:
        whole = b"" if not text else b" " + text.encode()
        a = tokens.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tokens.b.encode(text) if text else []
        if not text or b"".join(tokens.bytes_a[i] for i in a) != whole or b"".join(tokens.bytes_b[i] for i in b) != whole:
            rows.append(([], [], [], []))
            pairs.append([])
            continue
        ends_a, ends_b = (list(accumulate(len(t[i]) for i in ids)) for t, ids in ((tokens.bytes_a, a), (tokens.bytes_b, b)))
        common = sorted(set(ends_a) & set(ends_b))
        parts = [defaultdict(list), defaultdict(list)]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for x, e in zip(ids, ends, strict=True):
                parts[side][bisect_left(common, e)].append(x)
        rows.append((a, b, [(parts[0][k], parts[1][k]) for k in range(len(common))], common))
        at_a, at_b = dict(zip(ends_a, a, strict=True)), dict(zip(ends_b, b, strict=True))
        pairs.append([(at_a[e], at_b[e]) for e in common])
    count = Counter(p for own in pairs for p in own)
    top_a, top_b = defaultdict(int), defaultdict(int)
    for (x, y), n in count.items():
        top_a[x], top_b[y] = max(top_a[x], n), max(top_b[y], n)
    out = []
    for (a, b, groups, _), own in zip(rows, pairs, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(own), sum(count[p] == top_b[p[1]] for p in own), sum(count[p] == top_a[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


@pytest.fixture(scope="module")
def hard_texts(spark):
    rng = random.Random(9)
    marks = [" ", "  ", "\n", " \n ", "\t", " ", "　", "\x1c", "\x85", "​", ",", "'s", "<s>", "<|endoftext|>", "<unk>", "<0x41>", "naïve", "é", "日本語", "नमस्ते", "🙂🙂", "2026", "|", "\x00", "word", "Unbelievable", "ﬁ", "\r\n"]
    texts = [None, "", " ", "  ", "a", " a", "a ", "▁", "a▁b", "\n", "one two three", "one two three", "x" * 3_000, "日" * 700, " " * 500 + "y", "_" * 400, "<|endoftext|>", "</s>"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    return texts


@pytest.mark.parametrize("small", [True, False])
def test_token_alignment(spark, hard_texts, monkeypatch, small):
    if small:  # many units, and a memo that is started afresh
        monkeypatch.setattr(token_alignment, "UNIT_CHARS", 20_000)
        monkeypatch.setattr(token_alignment, "BLOCK_TEXTS", 5)
    docs = clashing(spark.createDataFrame(list(enumerate(hard_texts)), "doc_id long, text string").repartition(5))
    out = token_alignment.align_tokens(docs, keep_groups=True)
    added = ["n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_a", "count_sum", "groups_sha256", "groups"]
    assert out.columns == [c for c in docs.columns if c != "text" and c not in added] + added
    got = sorted(out.collect())
    assert [r.doc_id for r in got] == list(range(len(hard_texts))) and {r["a.b"] for r in got} == {"mine"}
    assert [tuple(r[c] for c in added[:-1]) for r in got] == alignment_by_brute_force(hard_texts)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 if r.groups else not r.groups_sha256 for r in got)
    assert token_alignment.align_tokens(docs.limit(0)).count() == 0


def test_cuts_of_a_worker(hard_texts, monkeypatch):
    """Units that end in the middle of a batch, and memos that fill up, in plain calls."""
    tokens = token_alignment.Tokens("byte_bpe_50k.json", "piece_bpe_32k.model")
    cuts = token_alignment.Cuts(tokens)
    for text in filter(None, hard_texts):
        own = cuts.cut(text)
        assert "".join(" " + c for c in own) == " " + text
        ours, theirs = zip(*tokens.encode(own), strict=True)
        assert [i for x in ours for i in x] == tokens.a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert [i for x in theirs for i in x] == tokens.b.encode(text)


def test_pair_counts(spark, hard_texts):
    got = token_alignment.pair_counts(spark.createDataFrame(list(enumerate(hard_texts)), "doc_id long, text string"))
    total = got.agg(F.sum("count")).first()[0]
    assert total == sum(r[3] for r in alignment_by_brute_force(hard_texts))
    assert got.where("best").groupBy("b").count().count() == got.select("b").distinct().count()


def whitened_by_brute_force(vectors, components=8):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    z = (d / n).astype(np.float64)
    values, lines = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:components]
    return n, [int(sum(c * c for c in row)) for row in d], z @ lines[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(5)
    base = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    bad = [(None, None), (1, None), (2, []), (3, [float("nan")] * 12), (4, [None] + [1.0] * 11), (5, [float("inf")] * 12), (6, [1.0] * 11)]
    rows = [(10 + i, [float(c) for c in v]) for i, v in enumerate(base)] + [(None, [0.0] * 12), (7, [0.0] * 12), (7, [0.0] * 12)]
    docs = clashing(spark.createDataFrame(bad + rows, "vec_id long, embedding array<float>").repartition(4))
    out = whitening.whiten(docs)
    added = ["n", "deviation", "whitened", "explained", "identity_error"]
    assert out.columns == [c for c in docs.columns if c not in added] + added
    got = sorted(out.collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    n, deviation, white, explained = whitened_by_brute_force([v for _, v in order])
    assert [r.vec_id for r in got] == [i for i, _ in order] and {r["a.b"] for r in got} == {"mine"}
    assert {r.n for r in got} == {n} and [int(r.deviation) for r in got] == deviation
    mine = np.array([r.whitened for r in got])
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * signs - white).max() < 1e-8
    assert np.allclose(got[0].explained, explained, rtol=1e-9) and got[0].identity_error < 1e-9
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(8)).max() < 1e-9


def test_whitening_of_little(spark):
    """No rows, one row, equal rows, fewer dimensions than components, and very large entries."""
    of = lambda rows: whitening.whiten(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()
    assert of([None, []]) == []
    (one,) = of([[1.0, 2.0]])
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, [None, None], [None, None], None)
    assert all(r.whitened == [None] * 3 and r.deviation == 0 for r in of([[0.5, 1.5, -2.0]] * 5))
    flat = of([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]])
    assert all(len(r.whitened) == 2 and r.whitened[0] is not None and r.whitened[1] is None and abs(r.explained[0] - 1) < 1e-12 for r in flat)
    big = of([[1e9, 0.0], [-1e9, 1.0], [0.0, 3.0]])
    want = whitened_by_brute_force([[1e9, 0.0], [-1e9, 1.0], [0.0, 3.0]], 2)
    assert sorted(int(r.deviation) for r in big) == sorted(want[1])
    assert len(of([[1e300, -1e300], [1.0, 2.0]])) == 2


def test_whitening_query(spark):
    got = queries.op13_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    ids = sorted(vectors)
    n, deviation, white, explained = whitened_by_brute_force([vectors[i] for i in ids])
    mine = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(mine) == 8 * n
    for k in range(8):
        own = np.array([mine[i, k + 1].whitened for i in ids])
        sign = np.sign(own @ white[:, k])
        assert np.abs(own * sign - white[:, k]).max() < 1e-6
        assert abs(mine[ids[0], k + 1].explained / explained[k] - 1) < 1e-9
    assert [mine[i, 1].deviation for i in ids] == deviation

"""The pipeline against plain-Python versions of its five stages, each judged on its own input."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, order_minhash, quality_rules, queries, source_mix

WORDS = "the of and to a in river stone market garden winter letter bridge window forest harbor paper silver morning engine yellow copper valley island".split()
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
BENCH = pa.schema([("item_id", pa.int64()), ("text", pa.string())])


def tables(folder, docs, labels, bench):
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, LABELS), ("benchmark", bench, BENCH)):
        columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
        pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema), f"{folder}/{name}.parquet")
    return str(folder)


def corpus():
    """Good and bad texts, shared lines, exact and near copies, benchmark passages, nulls."""
    rng = random.Random(21)
    speak = lambda n: " ".join(rng.choice(WORDS) + (str(rng.randrange(99)) if rng.random() < 0.3 else "") for _ in range(n))
    bench = [(1, speak(14)), (2, speak(6)), (3, None), (4, "?!")]
    texts, good = [], []

    def add(text, quality):
        texts.append(text)
        good.append(quality)

    for i in range(150):
        lines = [speak(12) for _ in range(rng.randrange(3, 9))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines)), "Subscribe to our letter today")
        if i % 5 == 0:
            lines.append("All rights reserved by the authors")
        if i % 19 == 0:
            lines.append(bench[i % 2][1].upper())
        add("\n".join(lines), 1)
    for _ in range(60):
        add("\n".join("# $$ click | here * & " + speak(5) for _ in range(8)), 0)
    for i in (3, 3, 3, 8, 8, 11):
        add(texts[i], 1)
    for i in (5, 7, 13):
        add(texts[i] + " end", 1)
    for text in (None, "", " \n ", "two words", "again and again and " * 40, speak(30_000)):
        add(text, None)
    docs = [(i, t, rng.choice(["en", "en", "de", "fr", None]), rng.choice([None, *("src%d" % k for k in range(17))]), len(t or "")) for i, t in enumerate(texts)]
    return docs, [(i, q, 0) for i, q in enumerate(good)], bench


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """The rows before and after every stage of ``run``, and the tables' folder."""
    folder = tables(tmp_path_factory.mktemp("corpus"), *corpus())
    steps, keep = [corpus()[0]], corpus_pipeline.written

    def recorded(df):
        out = keep(df)
        steps.append([tuple(r) for r in out.collect()])
        columns.append(out.columns)
        return out

    columns = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "written", recorded)
        last = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(map(repr, last)) == sorted(map(repr, steps[-1]))
    return folder, dict(zip(["documents", *(name for name, _ in corpus_pipeline.STAGES)], steps, strict=True)), columns


def by_id(rows):
    out = {r[0]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_columns_and_order_of_stages(ran):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    assert ran[2][:-1] == [SCHEMA.names] * 4
    assert ran[2][-1] == [*SCHEMA.names, "domain", "epoch", "n_tokens", "n_tokens_before"]
    sizes = [len(rows) for rows in ran[1].values()]
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 0


def test_quality_stage(spark, ran):
    """Every document by its base limits and by walking the trees node by node."""
    folder, steps, _ = ran
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.train(docs, labels)
    word, want = re.compile(r"[^\x20\x09-\x0D]+"), set()
    stats = {r.doc_id: r for r in quality_rules.judge_quality(docs, model).collect()}
    for row in steps["documents"]:
        own = word.findall(row[1] or "")
        windows = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
        count = Counter(windows)
        inside = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
        x = quality_rules.ratio_features(pd.DataFrame([{c: stats[row[0]][c] for c in quality_rules.COLUMNS}]))[0]
        total = model.base
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        score = 1 / (1 + math.exp(-total))
        assert stats[row[0]].score == pytest.approx(score)
        if len(own) >= 20 and 100 * len(inside) <= 30 * len(own) and score >= 0.5:
            want.add(row)
    assert set(steps["quality rules"]) == want
    kept = by_id(steps["quality rules"])
    labelled = {i: q for i, q, _ in corpus()[1]}
    assert not [i for i, q in labelled.items() if q == 0 and i in kept]
    assert sum(i in kept for i, q in labelled.items() if q == 1) >= 0.97 * sum(q == 1 for q in labelled.values())


def test_line_stage(ran):
    before, after = (by_id(ran[1][s]) for s in ("quality rules", "line dedup"))
    sites, first = defaultdict(set), {}
    for i in sorted(before):
        for at, line in enumerate((before[i][1] or "").split("\n")):
            sites[line].add(before[i][3] or "")
            first.setdefault(line, (i, at))
    assert set(after) == set(before)
    lost = 0
    for i, (_, text, lang, source, _n) in before.items():
        lines = (text or "").split("\n")
        kept = [x for at, x in enumerate(lines) if not x.strip(" ") or len(sites[x]) < queries.MIN_SITES or first[x] == (i, at)]
        lost += len(lines) - len(kept)
        text = "\n".join(kept)
        assert after[i] == (i, text, lang, source, len(text))
    assert lost > 50


def test_near_duplicate_stage(ran):
    before, after = (by_id(ran[1][s]) for s in ("line dedup", "MinHash near-dedup"))
    ids = sorted(before)
    shingles = {i: order_minhash.shingle_list(decontaminate.normal_words(before[i][1])) for i in ids}
    root = {i: i for i in ids}

    def top(i):
        return i if root[i] == i else top(root[i])

    for j, b in enumerate(ids):
        for a in ids[:j]:
            x, y = shingles[a], shingles[b]
            alike = len(x) <= 1.25 * len(y) and len(y) <= 1.25 * len(x) and len(set(x) & set(y)) >= 0.6 * min(len(x), len(y))
            if x and (x == y or alike and order_minhash.similarity(x, y) >= 0.8):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    groups = Counter(map(top, ids))
    assert max(groups.values()) >= 3
    left = Counter(map(top, after))
    assert set(left) == set(groups) and set(left.values()) == {1}
    assert all(after[i] == before[i] for i in after)


def test_decontamination_stage(ran):
    before, after = (by_id(ran[1][s]) for s in ("MinHash near-dedup", "benchmark decontamination"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for _, text in corpus()[2]:
        own = low(text)
        windows |= {tuple(own[k : k + min(10, len(own))]) for k in range(len(own) - min(10, len(own)) + 1) if own}
    sizes = {len(w) for w in windows}
    hit = {i for i, r in before.items() if (own := low(r[1])) and any(tuple(own[k : k + n]) in windows for n in sizes for k in range(len(own) - n + 1))}
    assert hit and after == {i: r for i, r in before.items() if i not in hit}


def test_mix_stage(ran):
    """Budgets and prefixes by the SQL over the stage's own input, and the rows' texts as they came."""
    before, mixed = ran[1]["benchmark decontamination"], ran[1]["mixing sources to target weights"]
    con = duckdb.connect()
    documents = pa.table([pa.array(c, t) for c, t in zip(zip(*before, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
    con.register("documents", documents)
    sql = source_mix.oracle(queries.MIX_DOMAIN_SQL, queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_EPOCHS, queries.MIX_SEED)
    want = sorted((r[0], r[1], *r[4:]) for r in con.execute(sql).fetchall())
    assert sorted((r[0], r[5], r[6], r[7], r[8]) for r in mixed) == want
    rows = by_id(before)
    assert all(r[:5] == rows[r[0]] for r in mixed)


def test_stages_on_hard_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, one very long text, and columns named like results."""
    docs, labels, bench = corpus()
    docs += [docs[3], docs[3], (None, docs[4][1], None, None, None), (None, None, None, None, None), (9, docs[10][1], "en", "src1", 5)]
    labels += [(None, 1, None), (3, None, None), (3, 0, 1)]
    folder = tables(tmp_path, docs, labels, [*bench, (None, bench[0][1])])
    clashing = "epoch domain score kept n_words n_lines n_removed items group_id row id n_tokens".split()
    out = spark.read.parquet(f"{folder}/documents.parquet")
    for c in clashing:
        out = out.withColumn(c, F.lit("mine"))
    sizes = [out.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, out, folder))
        assert out.columns == [*SCHEMA.names, *clashing], name
        assert {v for r in out.select(*clashing).distinct().collect() for v in r} == {"mine"}, name
        sizes.append(out.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 0


def test_empty_tables(spark, tmp_path):
    docs, labels, bench = corpus()
    assert corpus_pipeline.run(spark, tables(tmp_path, [], [], [])).count() == 0
    (tmp_path / "b").mkdir()
    some = corpus_pipeline.run(spark, tables(tmp_path / "b", docs[:40], [], []))
    assert some.count() > 0 and np.unique([r.doc_id for r in some.collect()]).size <= 40

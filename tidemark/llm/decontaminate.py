"""Benchmark decontamination with a broadcast set of test n-grams.

Items are normalised (ASCII lower case, words of letters, digits and non-ASCII
characters) and cut into windows of ``WINDOW`` words; a shorter item with a word
is one window.  The windows of a block of items are broadcast as sorted hashes,
every document is scanned once against each block, and each hash hit is
verified word by word.

The set is broadcast in blocks of ``BLOCK_WORDS`` item words or so (a longer item
is cut into overlapping parts), so what is sent at once has a fixed bound (about
16 bytes a word) whatever the benchmark's size.  A benchmark of one block takes
one pass.  Of a larger one each block is a pass of its own, whose hits are
written and whose broadcast is released before the next; the hits of all passes
are merged by position.

Edge cases: null and empty texts have no words; items without words never match;
repeated items and items with equal text all count; a null item id is an item,
comes first in ``items`` and isn't in the digest; rows are independent, so
repeated documents agree; an empty benchmark hits nothing; an empty table gives
an empty result; extra columns are kept, and columns named as a result are
replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import field, named, packed, ship_package, unpacked, written

WINDOW = 10
#: Item words that are broadcast at once.
BLOCK_WORDS = 2_000_000

#: ASCII bytes outside words become spaces, capitals become small.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


@dataclass
class GramBlock:
    """Windows of some items: vocabulary, and for each window length its sorted hashes."""

    words: dict[bytes, int]
    lengths: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[int, ...]], list[list]]]


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    h = np.zeros(len(ids) - length + 1, dtype=np.uint64)
    for k in range(length):
        h = (h ^ (h >> np.uint64(31))) * _ODD + ids[k : len(ids) - length + 1 + k]
    return h


def build_block(items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> GramBlock:
    words: dict[bytes, int] = {}
    grams: dict[int, dict[tuple[int, ...], list]] = defaultdict(dict)
    for item, own in items:
        ids = [words.setdefault(w, len(words) + 1) for w in own]
        size = min(window, len(ids))
        for k in range(len(ids) - size + 1):
            holders = grams[size].setdefault(tuple(ids[k : k + size]), [])
            if not holders or holders[-1] != item:
                holders.append(item)
    lengths = {}
    for size, found in grams.items():
        keys = list(found)
        h = window_hashes(np.array(keys, dtype=np.uint64).ravel(), size)[::size]
        order = np.argsort(h, kind="stable")
        lengths[size] = (h[order], order, keys, list(found.values()))
    return GramBlock(words, lengths)


def scan(words: list[bytes], block: GramBlock) -> tuple[np.ndarray, set]:
    """Start and end of each verified window in a document, and the items hit."""
    get = block.words.get
    ids = np.array([get(w, 0) for w in words], dtype=np.uint64)
    known = np.concatenate([[0], np.cumsum(ids > 0)])
    spans, items = [], set()
    for size, (hashes, order, keys, holders) in block.lengths.items():
        if len(ids) < size:
            continue
        starts = np.flatnonzero(known[size:] - known[:-size] == size)
        if not len(starts):
            continue
        h = window_hashes(ids, size)[starts]
        first = np.searchsorted(hashes, h)
        hit = first < len(hashes)
        hit[hit] = hashes[first[hit]] == h[hit]
        for start, at in zip(starts[hit].tolist(), first[hit].tolist(), strict=True):
            own, value = tuple(ids[start : start + size].tolist()), hashes[at]
            while at < len(hashes) and hashes[at] == value:
                if keys[order[at]] == own:
                    spans.append((start, start + size))
                    items.update(holders[order[at]])
                    break
                at += 1
    return np.array(spans, dtype=np.int64).reshape(-1, 2), items


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def item_blocks(benchmark: DataFrame, item: str, text: str, most_words: int, window: int = WINDOW) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Blocks of items, streamed to the driver one partition at a time."""
    block, size = [], 0
    for row in benchmark.where(named(text).isNotNull()).select(named(item), named(text)).toLocalIterator():
        words = normal_words(row[1])
        for start in range(0, max(min(len(words), 1), len(words) - window + 1), most_words):
            part = words[start : start + most_words + window - 1]
            block.append((row[0], part))
            size += len(part)
            if size >= most_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` and ``hit_spans``.

    ``hit_spans`` are the maximal runs of hit words as (first, last + 1).
    """
    return unpacked(_found(docs, benchmark, block_words, text, item, item_text), **{c: F.col(f"hits.{c}") for c in ("n_words", "n_hit", "items", "hit_spans")})


def _found(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (row, hits)."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = benchmark.schema[item].dataType.simpleString()
    schema = f"n_words long, n_hit long, items array<{kind}>, hit_spans array<array<long>>"
    blocks = map(build_block, item_blocks(benchmark, item, item_text, block_words))
    first, second = next(blocks, GramBlock({}, {})), next(blocks, None)
    if second is None:
        return packed(docs).withColumn("hits", _scanner(spark.sparkContext.broadcast(first), schema)(field(text)))
    rows = written(packed(docs).withColumn("key", F.monotonically_increasing_id()))
    passes = []
    for block in chain((first, second), blocks):
        shared = spark.sparkContext.broadcast(block)
        own = rows.select("key", _scanner(shared, schema)(field(text)).alias("h")).where("h.n_hit > 0").select("key", "h.items", "h.hit_spans")
        passes.append(written(own))
        shared.destroy()
    hits = reduce(DataFrame.unionByName, passes).groupBy("key").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("hit_spans")).alias("spans"))

    @F.pandas_udf(schema)
    def merged(texts: pd.Series, items: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = ((normal_words(t), set() if i is None else set(i), [] if s is None else [list(x) for x in s]) for t, i, s in zip(texts, items, spans, strict=True))
        return _result([(len(w), covered(np.array(s, dtype=np.int64).reshape(-1, 2), len(w)), i) for w, i, s in rows])

    return rows.join(hits, "key", "left").select("row", merged(field(text), "items", "spans").alias("hits"))


def _result(rows: list[tuple[int, np.ndarray, set]]) -> pd.DataFrame:
    """Results from the number of words, which of them are hit, and the items."""
    out = []
    for n, flags, items in rows:
        turns = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).reshape(-1, 2)
        out.append((n, int(flags.sum()), sorted(items, key=lambda x: (x is not None, x)), turns.tolist()))
    return pd.DataFrame(out, columns=["n_words", "n_hit", "items", "hit_spans"])


def _scanner(shared, schema: str):
    @F.pandas_udf(schema)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = normal_words(text)
            spans, items = scan(words, shared.value)
            rows.append((len(words), covered(spans, len(words)) if len(spans) else np.zeros(0, dtype=bool), items))
        return _result(rows)

    return scanned


def with_digest(found: DataFrame) -> DataFrame:
    """``n_items``, ``items_sha256`` and ``contaminated`` from ``items``."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(listed, 256), "contaminated": F.col("n_hit") > 0})


def remove_documents(docs: DataFrame, benchmark: DataFrame, most_hit_share: float = 0.0, **names: str) -> DataFrame:
    """Documents of which no more than ``most_hit_share`` of the words are hit, unchanged."""
    return unpacked(_found(docs, benchmark, **names).where(F.col("hits.n_hit") <= most_hit_share * F.col("hits.n_words")))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """All documents without their hit spans: from the first to the last word of each, as it stands."""

    @F.pandas_udf("string")
    def freed(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, spans, strict=True):
            if len(own):
                at = [m.span() for m in _WORD.finditer(t)]
                edges = [0, *(e for a, b in own for e in (at[a][0], at[b - 1][1])), len(t)]
                t = "".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append(t)
        return pd.Series(out, dtype=object)

    found = _found(docs, benchmark, text=text, **names)
    clean = F.when(F.size("hits.hit_spans") > 0, freed(field(text), "hits.hit_spans")).otherwise(field(text))
    return found.select(*(clean.alias(c) if c == text else field(c).alias(c) for c in docs.columns))

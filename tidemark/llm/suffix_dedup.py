"""Exact substring dedup by interval expansion on a Burrows-Wheeler transform.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier
(smaller document, or same document, earlier start) is removed; strings are
judged on the input and never cross documents.

A whole-corpus suffix array would have to stand in one place, so windows of
``LENGTH`` bytes are first dealt out by content.  The least hash of the byte
grams in a window is its anchor; equal windows have equal anchors, and
neighbouring windows with one anchor form a context.  Spark counts anchors, and
only windows whose anchor occurs twice can repeat.  A run whose period is so short
that every window of it holds all phases is one context; such a folded context,
in which the anchor's gram comes twice, counts as a repeated anchor by itself:

* equal contexts are one group by (anchor, digest); all but the first are
  removed whole;
* the first contexts of an anchor with several different ones, or with a folded
  one, are gathered in blocks of bounded size.  In each block the transform of the joined contexts is
  built, and intervals are extended backwards breadth-first: the intervals of
  round k are the strings of k bytes, their right ends are where neighbours in
  the suffix order share fewer than k bytes.  After ``LENGTH`` rounds, neighbours
  that are still not told apart share ``LENGTH`` bytes or more;
* an anchor whose contexts exceed ``HOT_BYTES`` isn't gathered at all: its
  contexts are cut again by anchors of another hash order, and what is still too
  much after ``ORDERS`` orders becomes one context a window, which (anchor,
  digest) groups settle.

Bitmaps of ``FILTER_BITS`` bits over hashes are broadcast to leave out single
anchors, and texts without repeats, before a shuffle; where a bitmap is full it
lets more pass, and results stay the same.

Edge cases: null and empty texts have no bytes; texts of under ``LENGTH`` bytes
lose nothing; rows of equal id and text are one document and get equal results;
rows of equal id and other text are ordered by a hash of the text; null ids come
first; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship_package, whole_text, written

LENGTH = 100
GRAM = 24
#: Bytes of contexts in a block, and of one anchor from which on it is split up.
BLOCK_BYTES = 1 << 18
HOT_BYTES = 1 << 20
#: Hash orders in which hot contexts are cut before their windows stand alone.
ORDERS = 3
#: Bits of a filter; its bitmap takes an eighth of that in bytes.
FILTER_BITS = 1 << 26
#: Bytes of text that are hashed at once, and of a section of a longer text.
CHUNK_BYTES = 1 << 15
SECTION_BYTES = 1 << 19

_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_WRAP = (1 << 64) - 1
_BYTE_VALUES = np.random.default_rng(100).integers(1, 2**63, 256, dtype=np.uint64)
_SEPARATOR = 0xFF


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all ``GRAM``-byte strings, put together from strings of 8 and 16 bytes."""
    h, parts = _BYTE_VALUES[data], {}
    size = 1
    while size < GRAM:
        factor = _U(pow(_MULTIPLIER, size, 1 << 64))
        h = h[:-size] * factor + h[size:]
        size *= 2
        parts[size] = h
        if size * 2 > GRAM:
            break
    rest = GRAM - size
    if rest:
        h = h[:-rest] * _U(pow(_MULTIPLIER, rest, 1 << 64)) + parts[rest][size:]
    return _mixed(h)


class Powers:
    """Powers of the digest's base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 8 * CHUNK_BYTES)
            self.up, self.down = (np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(b), dtype=np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


_POWERS = Powers()


def contexts(texts: list[bytes], order: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, anchor, digest, first and last window start of every context, and whether it is folded.

    ``order`` picks the hash order in which anchors are least.  Two equal windows
    of one context are a period apart, so one from the first up to before the
    second begins with the anchor's gram, and the window after it still has it:
    the context is folded.
    """
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(bytes([_SEPARATOR]).join([*texts, b""]), dtype=np.uint8)
    n = len(data) - LENGTH + 1
    if n < 1:
        return *(np.zeros(0, dtype=np.int64),) * 5, np.zeros(0, dtype=bool)
    h = gram_hashes(data)
    wide = LENGTH - GRAM + 1
    ranks = _mixed(h ^ _U(order * _MULTIPLIER & _WRAP)) if order else h
    least, step = ranks, 1
    while step * 2 <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: n if step < wide else None], least[wide - step :])[:n]
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    long = sizes > LENGTH
    edge[starts[long]] += 1
    edge[ends[long] - LENGTH] -= 1
    inside = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
    least = np.where(inside, np.maximum(least, _U(1)), _U(0))
    differs = least[1:] != least[:-1]
    cut = np.flatnonzero(differs) + 1
    again = np.concatenate([[0], np.cumsum(~differs & (ranks[: n - 1] <= least[:-1]))])
    low, high = np.concatenate([[0], cut]), np.concatenate([cut, [n]]) - 1
    used = least[low] > 0
    low, high = low[used], high[used]
    up, down = _POWERS.upto(len(h) + 1)
    sums = np.concatenate([[_U(0)], np.cumsum(h * up[: len(h)])])
    digest = _mixed((sums[high + wide] - sums[low]) * down[low] + (high - low).astype(np.uint64))
    doc = np.searchsorted(ends, low, side="right")
    return doc, least[low], digest, low - starts[doc], high - starts[doc], again[high] > again[low]


def backward_intervals(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first ``length`` bytes, and which entries share them with the entry before.

    The transform needs suffixes in order of ``length`` bytes only, since no
    interval is extended further.
    """
    order = bounded_suffix_order(data, length)
    n = len(data)
    bwt = data[order - 1]  # the byte before the first is the last
    by_byte = np.argsort(bwt, kind="stable").astype(np.int32)
    step = np.empty(n, dtype=np.int32)  # where an entry goes when its byte is put in front
    step[by_byte] = np.arange(n, dtype=np.int32)
    ranked = bwt[by_byte]
    same = ranked[1:] == ranked[:-1]
    before, after = np.full(n, -1, dtype=np.int32), np.full(n, n, dtype=np.int32)
    before[by_byte[1:][same]] = by_byte[:-1][same]
    after[by_byte[:-1][same]] = by_byte[1:][same]
    del by_byte, ranked, same, bwt
    shared = np.ones(n + 1, dtype=bool)  # not told apart yet from the entry before
    shared[0] = shared[n] = False
    low, high = np.zeros(1, dtype=np.int32), np.full(1, n, dtype=np.int32)
    for _ in range(length if n else 0):
        single = high - low == 1
        alone = low[single]
        wide_low, wide_high = low[~single], high[~single]
        size = wide_high - wide_low
        at = np.arange(size.sum(), dtype=np.int32) + np.repeat((wide_low - (np.cumsum(size) - size)).astype(np.int32), size)
        first = at[before[at] < np.repeat(wide_low, size)]
        last = at[after[at] >= np.repeat(wide_high, size)]
        new_low = np.concatenate([np.sort(step[first]), step[alone]])
        new_high = np.concatenate([np.sort(step[last]), step[alone]]) + np.int32(1)
        fresh = shared[new_high]
        low, high = new_low[fresh], new_high[fresh]
        shared[high] = False
        if not len(low):
            break
    return order, shared[:n]


def bounded_suffix_order(data: np.ndarray, length: int) -> np.ndarray:
    """Cyclic suffixes in order of at least ``length`` bytes, by prefix doubling of what is still tied."""
    n = len(data)
    long = np.concatenate([data, data[:8]]) if n >= 8 else np.resize(data, n + 8)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << _U(8)) | long[k : k + n]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    head = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, dtype=bool)
    del key
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), np.int32(0)))
    size = 8
    while size < length:
        open_ = ~head
        open_[:-1] |= ~head[1:]
        at = np.flatnonzero(open_).astype(np.int32)
        if not len(at):
            break
        members = order[at]
        key = (rank[members].astype(np.int64) << 32) | rank[(members + size) % n]
        by = np.argsort(key, kind="stable")
        order[at] = members[by]
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head[at] = new
        rank[order[at]] = np.maximum.accumulate(np.where(new, at, np.int32(0)))
        size *= 2
    return order


def repeated_windows(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece number, first and last start of the windows that also start earlier.

    ``pieces`` are contexts in document order.
    """
    data = np.frombuffer(bytes([_SEPARATOR]).join([*pieces, b""]), dtype=np.uint8)
    sizes = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
    ends = np.cumsum(sizes)
    order, shared = backward_intervals(data, LENGTH)
    left = np.repeat(ends, sizes) - 1 - np.arange(len(data))
    groups = np.flatnonzero(~shared)
    first = np.minimum.reduceat(order, groups) if len(groups) else order
    first = np.repeat(first, np.diff(np.concatenate([groups, [len(data)]])))
    gone = np.zeros(len(data) + 1, dtype=bool)
    gone[order] = (first < order) & (left[order] >= LENGTH)
    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8))).reshape(-1, 2)
    piece = np.searchsorted(ends, turns[:, 0], side="right")
    start = (ends - sizes)[piece]
    return piece, turns[:, 0] - start, turns[:, 1] - 1 - start


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Rows, offsets and bytes of neighbouring texts of about ``CHUNK_BYTES`` together.

    A text of over ``SECTION_BYTES`` comes in sections, each with the windows that
    begin in it, so what is held at once doesn't grow with a text.  Nulls are empty.
    """
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    sizes = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK_BYTES)) + 1
    for rows in np.split(np.arange(len(sizes)), cuts):
        texts = [t or b"" for t in column.slice(rows[0], len(rows)).to_pylist()] if len(rows) else []
        for row, text in zip(rows.tolist(), texts, strict=True):
            if len(text) > SECTION_BYTES:
                for base in range(0, len(text), SECTION_BYTES):
                    yield np.array([row]), np.array([base]), [text[base : base + SECTION_BYTES + LENGTH - 1]]
        short = [i for i, t in enumerate(texts) if LENGTH <= len(t) <= SECTION_BYTES]
        if short:
            yield rows[short], np.zeros(len(short), dtype=np.int64), [texts[i] for i in short]


def context_rows(docs: DataFrame, wanted: Broadcast | None = None) -> DataFrame:
    """Rows (id, version, anchor, digest, lo, hi, folded) of ``docs`` (id, version, body).

    With ``wanted``, a bitmap over the leading bits of anchors, only of anchors in it;
    without it, ``anchor`` alone, and once more for a folded context.
    """
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "anchor long" if wanted is None else f"id {fields['id']}, version long, anchor long, digest long, lo int, hi int, folded boolean"
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, base, chunk in _chunks(batch.column("body")):
                doc, anchor, digest, low, high, folded = contexts(chunk)
                if wanted is None:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate([anchor, anchor[folded]]))], ["anchor"])
                    continue
                used = np.flatnonzero(in_bitmap(wanted.value, anchor))
                at, shift = pa.array(own[doc[used]]), base[doc[used]]
                columns = [batch.column("id").take(at), batch.column("version").take(at), _signed(anchor[used]), _signed(digest[used]), pa.array((low[used] + shift).astype(np.int32)), pa.array((high[used] + shift).astype(np.int32)), pa.array(folded[used])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "version", "anchor", "digest", "lo", "hi", "folded"])

    return docs.mapInArrow(rows, schema)


def slot_bitmap(rows: DataFrame, key: Column) -> np.ndarray:
    """The trailing bits of the hash ``key`` that occur: ``FILTER_BITS`` bits, however many rows.

    The driver gets at most one bitmap of 4 KiB for each 32,768 bits.
    """
    slot = key.bitwiseAND(FILTER_BITS - 1) + 1
    parts = rows.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS >> 3, dtype=np.uint8)
    for part, bits in parts.collect():
        bitmap[(part - 1) * len(bits) :][: len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    return bitmap


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (keys & keys.dtype.type(FILTER_BITS - 1)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def documents_of(rows: DataFrame) -> Column:
    """Whether a document (id, version) may have rows in ``rows``; never false for one that has.

    It keeps texts that have none out of a shuffle.
    """
    shared = rows.sparkSession.sparkContext.broadcast(slot_bitmap(rows, F.xxhash64("id", "version")))

    @F.arrow_udf("boolean")
    def may_have(keys: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(shared.value, keys.to_numpy(zero_copy_only=False)))

    return may_have(F.xxhash64("id", "version"))


def with_pieces(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The bytes of contexts: rows (id, version, anchor, lo, piece)."""
    lists = firsts.groupBy("id", "version").agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("wanted"))

    @F.arrow_udf("array<struct<anchor: long, lo: int, piece: binary>>")
    def cut(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("anchor", pa.int64()), ("lo", pa.int32()), ("piece", pa.binary())]))
        rows = ((text.as_py(), items.as_py()) for text, items in zip(texts, wanted, strict=True))
        return pa.array(([{"anchor": x["anchor"], "lo": x["lo"], "piece": text[x["lo"] : x["hi"] + LENGTH]} for x in items] for text, items in rows), type=kind)

    keys = lists.select(F.col("id").alias("_id"), F.col("version").alias("_version"), "wanted")
    met = docs.where(documents_of(firsts)).join(keys, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")))
    return met.select("id", "version", F.explode(cut(F.col("body").cast("binary"), "wanted")).alias("p")).select("id", "version", "p.*")


def block_repeats(pieces: DataFrame, blocks: int) -> DataFrame:
    """Rows (id, version, lo, hi): windows of first contexts that start earlier in another one or the same."""
    kind = pieces.schema["id"].dataType.simpleString()

    def repeats(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("id", "version", "lo")], null_placement="at_start"))
        piece, low, high = repeated_windows(rows.column("piece").to_pylist())
        at = pa.array(piece)
        lo = rows.column("lo").to_numpy()[piece]
        return pa.table({"id": rows.column("id").take(at), "version": rows.column("version").take(at), "lo": (lo + low).astype(np.int32), "hi": (lo + high).astype(np.int32)})

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(repeats, f"id {kind}, version long, lo int, hi int")


def split_rows(pieces: DataFrame, order: int) -> DataFrame:
    """The contexts of ``pieces`` cut by anchors of another order: rows as from ``context_rows``."""
    kind = pieces.schema["id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, above = (batch.column(c).to_numpy() for c in ("lo", "anchor"))
            for own, base, chunk in _chunks(batch.column("piece")):
                piece, anchor, digest, low, high, folded = contexts(chunk, order)
                at = own[piece]
                anchor = _mixed(anchor ^ (above[at].view(np.uint64) * _U(_MULTIPLIER)))
                taken, shift = pa.array(at), first[at] + base[piece]
                columns = [batch.column("id").take(taken), batch.column("version").take(taken), _signed(anchor), _signed(digest), pa.array((low + shift).astype(np.int32)), pa.array((high + shift).astype(np.int32)), pa.array(folded)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "version", "anchor", "digest", "lo", "hi", "folded"])

    return pieces.mapInArrow(rows, f"id {kind}, version long, anchor long, digest long, lo int, hi int, folded boolean")


def window_rows(pieces: DataFrame) -> DataFrame:
    """Each window of ``pieces`` as a context of its own."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("piece") - LENGTH)).alias("at")
    single = pieces.select("id", "version", "lo", "piece", at)
    window = F.substring("piece", F.col("at") + 1, F.lit(LENGTH))
    return single.select("id", "version", F.xxhash64(window).alias("anchor"), F.xxhash64(F.lit(1), window).alias("digest"), (F.col("lo") + F.col("at")).alias("lo"), (F.col("lo") + F.col("at")).alias("hi"), F.lit(False).alias("folded"))


def context_groups(rows: DataFrame) -> DataFrame:
    """Rows (anchor, digest, first, n, folded): equal contexts, and where they stand first."""
    return rows.groupBy("anchor", "digest").agg(F.min(F.struct("id", "version", "lo", "hi")).alias("first"), F.count("*").alias("n"), F.bool_or("folded").alias("folded"))


def later_ones(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (id, version, lo, hi) of contexts that are not the first of their group."""
    many = groups.where("n > 1").select(F.col("anchor").alias("_anchor"), F.col("digest").alias("_digest"), "first")
    met = rows.join(many, (F.col("anchor") == F.col("_anchor")) & (F.col("digest") == F.col("_digest")))
    is_first = F.struct("id", "version", "lo").eqNullSafe(F.struct("first.id", "first.version", "first.lo"))
    return met.where(~is_first).select("id", "version", "lo", "hi")


def settle(docs: DataFrame, rows: DataFrame, order: int = 0) -> DataFrame:
    """Rows (id, version, lo, hi): windows in contexts ``rows`` that start earlier in another one or the same."""
    groups = written(context_groups(rows))
    whole = later_ones(rows, groups)
    size = F.sum(F.col("first.hi") - F.col("first.lo") + LENGTH)
    several = written(groups.groupBy("anchor").agg(F.count("*").alias("k"), size.alias("bytes"), F.bool_or("folded").alias("folded")).where("k > 1 or folded").select("anchor", "bytes"))
    mild, hot = F.col("bytes") <= HOT_BYTES, F.col("bytes") > HOT_BYTES
    total, most = several.agg(F.coalesce(F.sum(F.when(mild, F.col("bytes"))), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    met = written(groups.select(F.col("anchor").alias("a"), "first").join(several, F.col("a") == F.col("anchor")).select("first.*", "anchor", "bytes"))
    found = whole.unionByName(written(block_repeats(with_pieces(docs, met.where(mild)), int(total // BLOCK_BYTES) + 1)))
    if most <= HOT_BYTES:
        return found
    pieces = with_pieces(docs, met.where(hot))
    if order + 1 < ORDERS:
        return found.unionByName(settle(docs, written(split_rows(pieces, order + 1)), order + 1))
    single = written(window_rows(pieces))
    return found.unionByName(later_ones(single, context_groups(single)))


def repeats(docs: DataFrame) -> DataFrame:
    """Rows (id, version, lo, hi): starts of ``LENGTH``-byte strings that also start earlier.

    ``docs`` has (id, version, body), and no two rows of one id and version.
    """
    repeated = context_rows(docs).groupBy("anchor").count().where("count > 1")
    shared = docs.sparkSession.sparkContext.broadcast(slot_bitmap(repeated, F.col("anchor")))
    return settle(docs, written(context_rows(docs, shared)))


def merged_spans(ranges: list[dict]) -> list[list[int]]:
    """Maximal runs of bytes (first, last + 1) covered by the windows of start ranges."""
    if not ranges:
        return []
    both = np.array([(r["lo"], r["hi"] + LENGTH) for r in ranges], dtype=np.int64)
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    new = np.concatenate([[True], both[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:], [len(both)]]) - 1
    return np.column_stack([both[new, 0], reach[last]]).tolist()


def _removal(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    spans, kept = [], []
    for text, own in zip(texts, ranges, strict=True):
        body = text.as_py() or b""
        found = merged_spans(own.as_py())
        spans.append(found)
        edges = [0, *(e for span in found for e in span), len(body)]
        kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
    return pa.StructArray.from_arrays([pa.array(spans, type=pa.list_(pa.list_(pa.int64()))), pa.array(kept, type=pa.binary())], ["removed_spans", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``n_spans``, ``removed_spans`` and ``kept`` (binary) to ``docs``."""
    ship_package(docs.sparkSession)
    names = ["n_bytes", "n_removed", "n_spans", "removed_spans", "kept"]
    rest = docs.drop(*names)
    ids_repeat = not rest.groupBy(doc_id).count().where("count > 1").isEmpty()
    version = F.xxhash64(whole_text(text)) if ids_repeat else F.lit(0).cast("long")  # tells rows of one id apart
    bodies = rest.select(F.col(doc_id).alias("id"), version.alias("version"), whole_text(text).alias("body"))
    bodies = bodies.dropDuplicates(["id", "version"]) if ids_repeat else bodies
    ranges = written(repeats(bodies).groupBy("id", "version").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))
    keyed = rest.select(*(F.col(f"`{c}`").alias(f"_tm{i}") for i, c in enumerate(rest.columns)), F.col(doc_id).alias("id"), version.alias("version"))
    keyed = keyed.withColumn("_own", documents_of(ranges))
    sent = ranges.select(F.col("id").alias("_id"), F.col("version").alias("_version"), "ranges")
    met = keyed.where("_own").join(sent, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left").drop("_id", "_version")
    body = whole_text(f"_tm{rest.columns.index(text)}").cast("binary")
    removal = F.arrow_udf(_removal, "removed_spans array<array<long>>, kept binary")
    met = met.withColumn("found", removal(F.when(F.col("ranges").isNotNull(), body), "ranges"))
    met = met.withColumns({"spans": F.col("found.removed_spans"), "kept": F.when(F.col("ranges").isNull(), body).otherwise(F.col("found.kept"))})
    untouched = keyed.where("not _own").withColumns({"spans": F.array().cast("array<array<long>>"), "kept": body})
    columns = [*(f"_tm{i}" for i in range(len(rest.columns))), "spans", "kept"]
    both = met.select(*columns).unionByName(untouched.select(*columns))
    lengths = F.transform("spans", lambda s: s[1] - s[0])
    return both.select(
        *(F.col(f"_tm{i}").alias(c) for i, c in enumerate(rest.columns)),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.col("spans").alias("removed_spans"),
        "kept",
    )

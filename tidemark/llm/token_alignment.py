"""Cross-tokenizer alignment by a two-pointer merge of cumulative token ends.

A text is encoded by a byte-level tokenizer (A, after one space) and by a
piece tokenizer (B, which adds that space).  Where tokens of both end at one byte, a
group ends, and the two tokens that end there are a link.  Both tokenizers begin a
token at each space that follows a character other than white space, so texts are
cut there; a cut is encoded and merged once for each worker's memo, and texts are
put together from their cuts.  Where a vocabulary doesn't allow that, the text is
one cut.

Documents are gathered into units of about ``UNIT_CHARS`` characters inside
``mapInArrow``.  A unit lists its distinct links once, with their number, and each
document as positions of its cuts, so what is counted by ``groupBy`` and joined back
(count, and the highest count of each id of either side) is one row for each unit
and distinct link, however often it stands there.  Units then meet their joined
links in a cogroup; a unit is bounded, or one document.  Nothing is broadcast.

Edge cases: null and empty texts, and texts of which the joined bytes of A's or B's
tokens aren't the space and the text, have no tokens: zeros and the empty digest;
they count in no pair.  Rows are independent, so repeated rows count each and agree,
and null ids pass through.  Strings of special tokens in texts are plain text.  Ties
for the highest count are all highest.  An empty table gives an empty result.  All
columns but the text are kept, and columns named as a result are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tidemark.llm.common import field, named, ship_package, written
from tidemark.llm.token_counts import LATIN, PRE_TOKENS, byte_alphabet

#: Characters of the texts of a unit.
UNIT_CHARS = 6_000_000
#: Cuts a worker remembers; a unit ends there too.
MEMO_CUTS = 220_000
#: Texts whose new cuts are encoded together.
BLOCK_TEXTS = 64

_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_RESULTS = "n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_a long, count_sum long, groups_sha256 string"


class Tokens:
    """Both tokenizers by name: ids of a cut, and bytes of an id."""

    def __init__(self, first: str, second: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one worker a core already
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(first))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path(second))
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lone_space = self.b.piece_to_id("▁")
        kind = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        by_words = kind.get("type") == "ByteLevel" and kind.get("use_regex", True)
        self.quick = self._ranked(json.loads(self.a.to_str())["model"]) if by_words else None
        self.can_cut = by_words and all("▁" not in p[1:] or not p.strip("▁") for p in pieces)

    def _ranked(self, model: dict):
        """The same vocabulary for a faster library, where ids follow the order of the merges; else null."""
        import tiktoken

        vocab = model["vocab"]
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if model["type"] != "BPE" or None in merged or merged != sorted(set(merged)) or len(vocab) - len(merged) not in (256, 257):
            return None
        ranks = {self.bytes_a[i]: i for i in (*(i for t, i in vocab.items() if len(t) == 1), *merged)}
        if len(ranks) != 256 + len(merged) or sorted(ranks[bytes([b])] for b in range(256))[-1] > merged[0]:
            return None
        return tiktoken.Encoding("ranked", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        """A's ids of texts; those in which the libraries' letter classes may differ go to A's own."""
        if self.quick is None:
            return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        plain = [t.isascii() or bool(LATIN.match(t)) for t in texts]
        own = iter(self.a.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        quick = self.quick.encode_ordinary
        return [quick(t) if p else next(own).ids for t, p in zip(texts, plain, strict=True)]

    def encode(self, rests: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of each rest after one space."""
        ours = self.ids_of([" " + r for r in rests])
        theirs = self.b.encode(rests, num_threads=1)
        return ((x, y if r else [self.lone_space]) for x, y, r in zip(ours, theirs, rests, strict=True))


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of either side end where one of the other does; both rise, and end together.

    The two pointers of a merge move over whole arrays: each end is looked up among the other's.
    """
    return ends_b[np.searchsorted(ends_b, ends_a)] == ends_a, ends_a[np.searchsorted(ends_a, ends_b)] == ends_b


class Cuts(dict):
    """Number of each cut, new ones in order; what is known of them, by number."""

    def __init__(self, tokens: Tokens):
        super().__init__()
        self.tokens = tokens
        self.new: list[str] = []
        self.text: list[str | None] = []
        self.chars = 0
        self.n_a, self.n_b = array("q"), array("q")
        self.links, self.ends = array("q"), array("q", [0])
        self.size_a, self.size_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (tokens.bytes_a, tokens.bytes_b))
        self.lengths_a, self.lengths_b = self.size_a.tolist(), self.size_b.tolist()
        #: How a token is written: within its group and as its last one, A's before B's.
        self.written = [f"{i}{mark}" for i in range(len(self.size_a)) for mark in ",|"] + [f"{i}{mark}" for i in range(len(self.size_b)) for mark in ",;"]
        self.width = np.array(list(map(len, self.written)), dtype=np.int64)

    def __missing__(self, rest: str) -> int:
        self[rest] = number = len(self)
        self.new.append(rest)
        return number

    def learn(self) -> None:
        """Encode and merge the new cuts; the text of one that doesn't give its bytes back is null."""
        if not self.new:
            return
        pairs = list(self.tokens.encode(self.new))
        wholes = [b" " + r.encode() for r in self.new]
        good = self._lossless(pairs, wholes)
        held = list(compress(pairs, good))
        count_a, count_b = (np.fromiter((len(x[i]) for x in held), dtype=np.int64, count=len(held)) for i in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(x[i] for x in held), dtype=np.int64, count=n.sum()) for i, n in ((0, count_a), (1, count_b)))
        texts, links, ends = iter(()), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if held:
            last_a, last_b = merge_ends(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
            links = a[last_a] << 32 | b[last_b]
            stop_a, stop_b = np.cumsum(count_a), np.cumsum(count_b)
            ends = np.cumsum(last_a)[stop_a - 1]
            # A group is written as A's tokens, then B's: each token comes after those of the other side that belong before it.
            codes = np.empty(len(a) + len(b), dtype=np.int64)
            before_a = np.concatenate([[0], np.flatnonzero(last_b) + 1])[np.cumsum(last_a) - last_a]
            codes[np.arange(len(a)) + before_a] = 2 * a + last_a
            codes[np.arange(len(b)) + (np.flatnonzero(last_a) + 1)[np.cumsum(last_b) - last_b]] = 2 * len(self.size_a) + 2 * b + last_b
            whole = "".join(map(self.written.__getitem__, codes.tolist()))
            stops = np.cumsum(self.width[codes])[stop_a + stop_b - 1].tolist()
            texts = (whole[i : j - 1] for i, j in zip([0, *stops], stops, strict=False))
        base, at = len(self.links), iter((ends + len(self.links)).tolist())
        for rest, (own_a, own_b), fine in zip(self.new, pairs, good, strict=True):
            self.text.append(next(texts) if fine else None)
            self.n_a.append(len(own_a))
            self.n_b.append(len(own_b))
            base = next(at) if fine else base
            self.ends.append(base)
            self.chars += len(rest)
        self.links.frombytes(links.tobytes())
        self.new = []

    def _lossless(self, pairs: list[tuple[list[int], list[int]]], wholes: list[bytes]) -> list[bool]:
        """Whether the bytes of either side's tokens are those of the cut; all cuts at once, and one by one only if that fails."""
        sides = ((0, self.tokens.bytes_a), (1, self.tokens.bytes_b))
        sizes = list(map(len, wholes))
        all_sizes = all([sum(map(size.__getitem__, p[i])) for p in pairs] == sizes for i, size in ((0, self.lengths_a), (1, self.lengths_b)))
        joined = b"".join(wholes)
        if all_sizes and all(b"".join(map(table.__getitem__, chain.from_iterable(p[i] for p in pairs))) == joined for i, table in sides):
            return [True] * len(pairs)
        return [all(b"".join(map(table.__getitem__, p[i])) == w for i, table in sides) for p, w in zip(pairs, wholes, strict=True)]

    def cut(self, text: str) -> list[str]:
        """The cuts of a text, each without its leading space."""
        if not self.tokens.can_cut:
            return [text]
        if _AFTER_SPACE.search(" " + text):
            return [c[1:] for c in _CUT.split(" " + text)]
        return text.split(" ")

    def is_full(self) -> bool:
        return len(self) > MEMO_CUTS or self.chars > UNIT_CHARS


class Unit:
    """Documents gathered so far: their cuts by number, and what is known without the corpus."""

    def __init__(self, keep_groups: bool):
        self.keep_groups = keep_groups
        self.rows: list[pa.Array] = []
        self.numbers: list[np.ndarray] = []
        self.facts: list[tuple] = []
        self.chars = 0

    def add(self, rows: pa.Array, texts: list[str | None], cuts: Cuts) -> None:
        found = [np.fromiter(map(cuts.__getitem__, own := cuts.cut(t)), dtype=np.int64, count=len(own)) if t else np.zeros(0, dtype=np.int64) for t in texts]
        cuts.learn()
        n_a, n_b, ends = (np.frombuffer(x, dtype=np.int64) if len(x) else np.zeros(0, dtype=np.int64) for x in (cuts.n_a, cuts.n_b, cuts.ends))
        for numbers in found:
            parts = [cuts.text[i] for i in numbers.tolist()]
            if not parts or None in parts:
                self.numbers.append(np.zeros(0, dtype=np.int64))
                self.facts.append((0, 0, 0, "", "" if self.keep_groups else None))
                continue
            text = ";".join(parts)
            self.numbers.append(numbers)
            self.facts.append((int(n_a[numbers].sum()), int(n_b[numbers].sum()), int((ends[numbers + 1] - ends[numbers]).sum()), hashlib.sha256(text.encode()).hexdigest(), text if self.keep_groups else None))
        self.rows.append(rows)
        self.chars += sum(len(t) for t in texts if t)

    def batches(self, number: int, cuts: Cuts, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row for each document, then one that lists the unit's links."""
        times = np.bincount(np.concatenate(self.numbers), minlength=len(cuts))
        used, local = np.flatnonzero(times), np.cumsum(times > 0) - 1
        ends = np.array(cuts.ends)
        sizes = ends[used + 1] - ends[used]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(ends[used] - starts[:-1], sizes) + np.arange(starts[-1])
        keys, place = np.unique(np.array(cuts.links)[at], return_inverse=True)
        counts = np.bincount(place, weights=np.repeat(times[used], sizes), minlength=len(keys)).astype(np.int64)
        docs = {
            "row": pa.concat_arrays(self.rows),
            "cuts": pa.array([local[n].astype(np.int32).tobytes() for n in self.numbers], pa.binary()),
            **dict(zip(("n_a", "n_b", "n_links", "sha", "groups"), map(list, zip(*self.facts, strict=True)), strict=True)),
        }
        table = {"keys": [keys], "counts": [counts], "starts": [starts.astype(np.int64).tobytes()], "at": [place.astype(np.int32).tobytes()]}
        for n, columns in ((len(self.numbers), docs), (1, table)):
            columns["unit"] = [number] * n
            cols = [c if isinstance(c := columns.get(f.name), pa.Array) else pa.array(c, f.type) if c is not None else pa.nulls(n, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)


#: One memo for each pair of tokenizers and worker, so that it outlives a task.
_CUTS: dict[tuple[str, str], Cuts] = {}


def encoded(docs: DataFrame, text: str, first: str, second: str, keep_groups: bool) -> DataFrame:
    """Units: rows (unit, row, n_a, n_b, n_links, sha, groups, cuts) of documents, and one (unit, keys, counts, starts, at) each."""
    others = [named(c).alias(c) for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    rows = docs.select(F.struct(*others).alias("row"), named(text).cast("string").alias("text"))
    own = _parse_datatype_string("unit long, n_a long, n_b long, n_links long, sha string, groups string, cuts binary, keys array<long>, counts array<long>, starts binary, at binary")
    kind = StructType([StructField("row", rows.schema["row"].dataType, True), *own.fields])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (first, second) not in _CUTS:
            _CUTS[first, second] = Cuts(Tokens(first, second))
        number, unit, schema = TaskContext.get().partitionId() << 32, Unit(keep_groups), None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, chars = [], 0
                while at + len(texts) < batch.num_rows and len(texts) < BLOCK_TEXTS and chars < UNIT_CHARS:
                    texts.append(batch.column(1)[at + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                unit.add(batch.column(0).slice(at, len(texts)), texts, _CUTS[first, second])
                schema = schema or _schema(batch.schema.field("row"))
                at += len(texts)
                if unit.chars >= UNIT_CHARS or _CUTS[first, second].is_full():
                    yield from unit.batches(number, _CUTS[first, second], schema)
                    number, unit = number + 1, Unit(keep_groups)
                    if _CUTS[first, second].is_full():
                        _CUTS[first, second] = Cuts(_CUTS[first, second].tokens)
        if unit.rows:
            yield from unit.batches(number, _CUTS[first, second], schema)

    return rows.mapInArrow(units, kind)


def _schema(row: pa.Field) -> pa.Schema:
    longs = pa.list_(pa.int64())
    kinds = {"unit": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_links": pa.int64(), "sha": pa.string(), "groups": pa.string(), "cuts": pa.binary(), "keys": longs, "counts": longs, "starts": pa.binary(), "at": pa.binary()}
    return pa.schema([pa.field("row", row.type), *(pa.field(n, t) for n, t in kinds.items())])


def unit_links(units: DataFrame) -> DataFrame:
    """Rows (unit, pos, key, n): the distinct links of each unit."""
    return units.where("keys is not null").select("unit", F.posexplode(F.arrays_zip("keys", "counts")).alias("pos", "link")).select("unit", "pos", F.col("link.keys").alias("key"), F.col("link.counts").alias("n"))


def counted(links: DataFrame) -> DataFrame:
    """Rows (key, a, b, count, best_a, best): each id pair's links, and whether no other pair of its id has more."""
    counts = links.groupBy("key").agg(F.sum("n").alias("count")).select("key", F.shiftright("key", 32).alias("a"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "count")
    counts = written(counts)
    for side, best in (("a", "best_a"), ("b", "best")):
        top = counts.select(side, "count").groupBy(side).agg(F.max("count").alias("top"))
        counts = counts.join(top, side).withColumn(best, F.col("count") == F.col("top")).drop("top")
    return counts


def pair_counts(docs: DataFrame, text: str = "text", first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model") -> DataFrame:
    """Rows (a, b, count, best_a, best): the id pairs that are linked anywhere in ``docs``."""
    ship_package(docs.sparkSession)
    return counted(unit_links(written(encoded(docs.select(named(text)), text, first, second, False)))).select("a", "b", "count", "best_a", "best")


def align_tokens(docs: DataFrame, text: str = "text", first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", keep_groups: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, with the counts of tokens, groups and links, and the digest of the groups.

    ``n_best`` are links whose pair is the most frequent of its B id, ``n_best_a`` of
    its A id; ``count_sum`` adds up the counts of the pairs.  With ``keep_groups`` the
    groups themselves follow as ``groups``.
    """
    ship_package(docs.sparkSession)
    units = written(encoded(docs, text, first, second, keep_groups))
    links = unit_links(units)
    judged = links.join(counted(links).select("key", "count", "best_a", "best"), "key").select(F.col("unit").alias("of"), "pos", "count", "best_a", "best")
    results = _parse_datatype_string(_RESULTS + (", groups string" if keep_groups else ""))
    kind = StructType([StructField("row", units.schema["row"].dataType, True), *results.fields])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = left.filter(pc.is_valid(left["row"]))
        table = left.filter(pc.is_valid(left["starts"]))
        starts, at = (np.frombuffer(table[c][0].as_py(), dtype=t) for c, t in (("starts", np.int64), ("at", np.int32)))
        values = np.zeros((3, right.num_rows), dtype=np.int64)
        pos = right["pos"].to_numpy()
        for i, c in enumerate(("best", "best_a", "count")):
            values[i, pos] = right[c].to_numpy().astype(np.int64)
        each = np.concatenate([np.zeros((3, 1), dtype=np.int64), np.cumsum(values[:, at], axis=1)], axis=1)
        each = each[:, starts[1:]] - each[:, starts[:-1]]  # by cut
        sums = np.array([each[:, np.frombuffer(c, dtype=np.int32)].sum(axis=1) for c in mine["cuts"].to_pylist()], dtype=np.int64).reshape(-1, 3)
        out = {"row": mine["row"], "n_a": mine["n_a"], "n_b": mine["n_b"], "n_groups": mine["n_links"], "n_links": mine["n_links"], "n_best": pa.array(sums[:, 0]), "n_best_a": pa.array(sums[:, 1]), "count_sum": pa.array(sums[:, 2]), "groups_sha256": mine["sha"]}
        return pa.table(out | ({"groups": mine["groups"]} if keep_groups else {}))

    parts = units.drop("keys", "counts").groupBy("unit").cogroup(judged.groupBy("of")).applyInArrow(summed, kind)
    added = [f.name for f in results.fields]
    return parts.select(*(field(c).alias(c) for c in docs.columns if c != text and c not in added), *added)

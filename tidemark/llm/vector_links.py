"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are brought to unit length.  Each of several hash tables takes ``k`` Gaussian
projections, shifts them and cuts them into cells of ``WIDTH``; the cells of a
vector, with its label, are its bucket in that table.  Vectors that share a bucket
are compared by exact cosine in double precision, so no pair under the threshold is
a link.

The number of projections follows the rows of the largest label, so that a vector
meets about ``MATES`` unrelated ones a table; the number of tables follows from it,
so that a pair exactly at the threshold shares no bucket with a chance of ``MISS``
at most, and less the more alike it is (at cosine 0.96 under 1e-7).

Equal vectors of a label are one node with a weight.  Only nodes that are not alone
in a bucket are sent to it.  A bucket of many nodes is cut into parts of about
``PART`` nodes, and each two parts are compared in a group of their own, so no task
gathers a whole bucket.  A group returns one row for each node with links (their
number, and the least node it is connected to there), never the pairs.  A pair that
meets in several tables counts in the first one alone.

Projections are rounded to integers so that their sums are exact in double
precision, and a vector has the same buckets wherever they are computed.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite entries,
and vectors of null label, link with nothing and are components of their own;
vectors of unlike length link with nothing; every row is a vector, so repeated rows
and rows of equal id link with each other like any others and share a component;
null ids are never the name of a component that has another id; an empty table gives
an empty result; extra columns are kept, and columns named as a result are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import field, packed, release, ship_package, unpacked, written
from tidemark.llm.order_minhash import components

THRESHOLD = 0.93
#: Width of a cell, a power of two so that dividing by it is exact.
WIDTH = 2.0
#: Unrelated vectors that a vector meets in a table on average, at most.
MATES = 0.125
#: Chance that a pair at the threshold shares no bucket.
MISS = 1e-4
#: Nodes of a bucket that are compared together.
PART = 1_024
#: Groups up to this size are compared many at a time.
SMALL = 6
#: Binary digits kept of unit vectors and of projections.
UNIT_BITS, PROJECTION_BITS = 22, 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at this distance fall into one cell of a projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Projections of a table, and the number of tables, for so many rows of one label."""
    near, far = collision(math.sqrt(max(2 - 2 * threshold, 1e-6))), collision(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(rows, 1) / MATES) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-(near**k))))


@functools.lru_cache(maxsize=4)
def projections(dim: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([seed, dim, k, tables]))
    lines = np.rint(rng.standard_normal((dim, k * tables)) * 2.0**PROJECTION_BITS)
    return lines, np.floor(rng.random(k * tables) * WIDTH * 2.0 ** (UNIT_BITS + PROJECTION_BITS))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; they are finite and not zero."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def bucket_numbers(units: np.ndarray, sides: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """A 64-bit number of each row's bucket in each table."""
    lines, shift = projections(units.shape[1], k, tables, seed)
    out = np.empty((len(units), tables), dtype=np.int64)
    for at in range(0, len(units), 1_024):
        dots = np.rint(units[at : at + 1_024] * 2.0**UNIT_BITS) @ lines
        cells = np.floor((dots + shift) / (WIDTH * 2.0 ** (UNIT_BITS + PROJECTION_BITS))).astype(np.int64).view(np.uint64).reshape(-1, tables, k)
        h = sides[at : at + 1_024, None].view(np.uint64) * _MIX + np.arange(tables, dtype=np.uint64)
        for i in range(k):
            h = (h ^ (h >> np.uint64(29))) * _MIX + cells[:, :, i]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        out[at : at + 1_024] = (h ^ (h >> np.uint64(29))).view(np.int64)
    return out


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length, stored as bytes of doubles."""
    return np.frombuffer(b"".join(vectors.to_pylist()), dtype=np.float64).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield np.flatnonzero(dims == dim), dim


def node_rows(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """``rows`` (row) with ``node``: digest, dim and bytes of each vector that can link."""

    @F.pandas_udf("digest binary, dim int, body binary")
    def read(vectors: pd.Series, labels: pd.Series) -> pd.DataFrame:
        out = []
        for v, side in zip(vectors, labels, strict=True):
            a = None if v is None or side is None else np.array(v, dtype=np.float64) + 0.0  # null entries become nan
            if a is None or not len(a) or not np.isfinite(a).all() or not a.any():
                out.append((None, None, None))
                continue
            body = a.tobytes()
            out.append((hashlib.blake2b(f"{side}\0".encode() + body, digest_size=16).digest(), len(a), body))
        return pd.DataFrame(out, columns=["digest", "dim", "body"]).astype({"dim": "Int32"})

    return rows.withColumn("node", read(field(vector), field(label).cast("string")))


def buckets(nodes: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """Rows (node, bucket), one for each node and table."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, dim in _by_length(batch):
                part = batch.take(pa.array(at))
                numbers = bucket_numbers(unit_rows(matrix(part.column("body"), dim)), part.column("side").to_numpy(), k, tables, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), tables)), pa.array(numbers.ravel())], ["node", "bucket"])

    return nodes.select("node", "side", "dim", "body").mapInArrow(hashed, "node long, bucket long")


def _linked(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: np.ndarray, crossed: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked rows of the groups ``starts`` to ``ends``.

    ``second`` marks the rows of the second part; in a ``crossed`` group, rows meet rows of the other part alone.
    """
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    sizes = ends - starts
    few = sizes <= SMALL
    size = np.repeat(np.where(few, ends, 0), sizes)  # where a small group ends
    at = np.arange(len(units))
    mixed = np.repeat(crossed, sizes)
    for step in range(1, SMALL):
        a = at[at + step < size]
        b = a + step
        met = ~mixed[at + step < size] | (second[a] != second[b])
        a, b = a[met], b[met]
        hit = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
        left.append(a[hit])
        right.append(b[hit])
    for lo, hi, cross in zip(starts[~few].tolist(), ends[~few].tolist(), crossed[~few].tolist(), strict=True):
        rows = np.arange(lo, hi)
        a, b = (rows[~second[lo:hi]], rows[second[lo:hi]]) if cross else (rows, rows)
        i, j = np.nonzero(units[a] @ units[b].T >= threshold)
        keep = slice(None) if cross else i < j
        left.append(a[i[keep]])
        right.append(b[j[keep]])
    return np.concatenate(left), np.concatenate(right)


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row is connected to by the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def first_meeting(numbers: np.ndarray, a: np.ndarray, b: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether ``bucket`` is the first bucket that the rows of each pair share."""
    out, open_pairs = np.zeros(len(a), dtype=bool), np.arange(len(a))
    for t in range(numbers.shape[1]):
        ours = numbers[a[open_pairs], t]
        met = ours == numbers[b[open_pairs], t]
        out[open_pairs[met]] = ours[met] == bucket[open_pairs[met]]
        open_pairs = open_pairs[~met]
        if not len(open_pairs):
            break
    return out


def compared(sent: DataFrame, k: int, tables: int, seed: int, threshold: float) -> DataFrame:
    """Rows (node, links, near) from rows that stand in order of (bucket, p, q)."""

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for at, dim in _by_length(batch):
            part = batch.take(pa.array(at))
            c = {n: part.column(n).to_numpy() for n in ("bucket", "p", "q", "part", "node", "side", "weight")}
            units = unit_rows(matrix(part.column("body"), dim))
            edge = np.flatnonzero(np.concatenate([[True], np.any([c[n][1:] != c[n][:-1] for n in ("bucket", "p", "q")], axis=0)]))
            crossed = c["p"][edge] != c["q"][edge]
            a, b = _linked(units, edge, np.append(edge[1:], len(at)), c["part"] != c["p"], crossed, threshold)
            same = c["side"][a] == c["side"][b]
            a, b = a[same], b[same]
            if not len(a):
                continue
            rows = np.unique(np.concatenate([a, b]))
            numbers = bucket_numbers(units[rows], c["side"][rows], k, tables, seed)
            first = first_meeting(numbers, np.searchsorted(rows, a), np.searchsorted(rows, b), c["bucket"][a])
            a, b = a[first], b[first]
            links = np.zeros(len(at), dtype=np.int64)
            np.add.at(links, a, c["weight"][b])
            np.add.at(links, b, c["weight"][a])
            root = _local_roots(len(at), a, b)
            some = np.flatnonzero(links)
            out.append((c["node"][some], links[some], c["node"][root[some]]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["node", "links", "near"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            keys = [batch.column(n).to_numpy() for n in ("bucket", "p", "q")]
            same = np.all([x == x[-1] for x in keys], axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on in the next batch
            if cut:
                yield judge(batch.slice(0, cut))
            rest = batch.slice(cut)
        if rest is not None:
            yield judge(rest)

    return sent.mapInArrow(groups, "node long, links long, near long")


def link_counts(nodes: DataFrame, threshold: float, miss: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows (node, links) and the edges (a, b) that connect what is linked; ``nodes`` has (node, side, dim, body, weight)."""
    most = nodes.groupBy("side", "dim").count().agg(F.max("count")).first()[0] or 1
    k, tables = plan_tables(most, threshold, miss)
    keys = written(buckets(nodes, k, tables, seed))
    sizes = keys.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    shared = keys.join(sizes, "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "parts")).alias("at"))  # no more entries than tables
    placed = nodes.join(shared, "node").withColumn("at", F.explode("at")).select("node", "side", "dim", "body", "weight", "at.*")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sent = placed.withColumn("other", other).select("bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "side", "dim", "body", "weight")
    met = written(compared(sent.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q"), k, tables, seed, threshold))
    release(keys)
    return met.groupBy("node").agg(F.sum("links").alias("links")), met.where("node <> near").select(F.col("near").alias("a"), F.col("node").alias("b")).distinct()


def oracle(threshold: float = THRESHOLD) -> str:
    return f"""
WITH RECURSIVE able AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(list_filter(embedding, lambda c: isfinite(c))) = len(embedding)
    AND list_count(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
names AS (SELECT a, min(b) AS name FROM reached GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, m.name AS component_id, e.vec_id = m.name AS kept
FROM embeddings e JOIN names m ON e.vec_id = m.a LEFT JOIN counts c ON e.vec_id = c.a
"""


def with_links(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, miss: float = MISS, seed: int = 11) -> DataFrame:
    """``vectors`` with ``n_links``, ``component_id`` and ``kept`` (its id names its component)."""
    ship_package(vectors.sparkSession)
    rows = node_rows(packed(vectors), vector, label)
    own = rows.where("node.digest is not null").select(field(vec_id).alias("id"), F.xxhash64(field(label).cast("string"), "node.dim").alias("side"), "node.*")
    alike = own.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("side").alias("side"), F.first("dim").alias("dim"), F.first("body").alias("body"))
    nodes = written(alike.withColumn("node", F.monotonically_increasing_id()))
    counts, edges = link_counts(nodes, threshold, miss, seed)
    rooted = nodes.select("node", "digest", "least", "weight").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.join(counts, "node", "left")
    names = rooted.groupBy("root").agg(F.min("least").alias("name"))
    found = rooted.join(names, "root").select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "name")
    joined = rows.join(written(found), F.col("node.digest") == F.col("digest"), "left")
    name = F.coalesce("name", field(vec_id))
    return unpacked(joined, n_links=F.coalesce("links", F.lit(0).cast("long")), component_id=name, kept=field(vec_id).eqNullSafe(name))

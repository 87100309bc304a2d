"""Embedding whitening by a covariance of two passes.

Entries become whole numbers (``floor(SCALE * c) + OFFSET``).  The first pass sums
them exactly, which gives the mean without rounding.  The second pass centres each
block of vectors and adds up its outer products by one matrix product; partial
matrices are merged in a tree.  What reaches the driver is one matrix, whose size
depends on the vectors' length alone; its symmetric eigenvectors are LAPACK's.  The
projection (length x components) is broadcast.  A last pass over all vectors
measures how far the covariance of what was whitened is from the identity.

Inputs and edge cases: rows whose vector is null, empty, or holds null or non-finite
entries are dropped, and so are rows whose vector isn't as long as most are (of equally
many, the longer), since a covariance needs one length.  Repeated rows count each.
Where there are fewer dimensions than components, there are fewer components.  A
component whose variance is zero to double precision (equal vectors, a single row)
has null for ``whitened``; ``explained`` is null where nothing varies at all.  A sum
of squares beyond 38 digits is null.  An empty table gives an empty result.  Extra
columns are kept, and columns named as a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import field, named, packed, ship_package, unpacked

SCALE, OFFSET = 1_024, 100_000
COMPONENTS = 8
#: Share of the whole variance under which a component's is zero.
NEGLIGIBLE = 1e-12
#: Whole numbers below this can be added and multiplied in 64 bits.
SAFE = 2**62


@dataclass
class Whitening:
    """What the passes found; components are the columns of ``projection``."""

    n: int
    sums: list[int]
    projection: np.ndarray
    variances: list[float]
    trace: float
    identity_error: float | None = None


def is_usable(vector: Column) -> Column:
    real = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & real


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    most = 2.0**62
    return np.clip(np.floor(SCALE * vectors), -most, most).astype(np.int64) + OFFSET


def exact_sums(x: np.ndarray) -> list[int]:
    if np.abs(x.astype(np.float64)).max(initial=0) * len(x) < SAFE:
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly: in 64 bits where they fit, else Python's integers."""
    if n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums)) < SAFE:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def squared_lengths(d: np.ndarray) -> list[int]:
    if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < SAFE:
        return (d * d).sum(axis=1).tolist()
    return (d.astype(object) ** 2).sum(axis=1).tolist()


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


def _vectors(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _merged(vectors: DataFrame, dim: int, block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``block``, a matrix of doubles, merged in a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = block(whole_numbers(_vectors(batch.column(0), dim)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])

    parts = vectors.mapInArrow(partial, "m binary").rdd.map(lambda r: np.frombuffer(r.m))
    return parts.treeAggregate(None, _plus, _plus)


def _plus(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    return b if a is None else a if b is None else a + b


def _count_and_sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            n += batch.num_rows
            sums = [a + b for a, b in zip(sums, exact_sums(whole_numbers(_vectors(batch.column(0), dim))), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in (n, *sums)]])], ["v"])

    add = lambda a, b: b if a is None else a if b is None else [x + y for x, y in zip(a, b, strict=True)]
    total = vectors.mapInArrow(partial, "v array<string>").rdd.map(lambda r: list(map(int, r.v))).treeAggregate(None, add, add)
    return total[0], total[1:]


def common_length(vectors: DataFrame) -> int | None:
    """The length that most of the vectors (v) have."""
    sizes = vectors.groupBy(F.size("v").alias("dim")).count()
    return sizes.agg(F.max_by("dim", F.struct("count", "dim"))).first()[0]


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """Mean, eigenvectors and the check of all ``vectors`` (v), which are of length ``dim``."""
    n, sums = _count_and_sums(vectors, dim)

    def outer(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums)
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    total = _merged(vectors, dim, outer)
    covariance, left = total[:-dim].reshape(dim, dim) / n, total[-dim:] / n  # left: what rounding leaves of the mean
    values, lines = np.linalg.eigh((covariance + covariance.T) / 2)
    first = np.argsort(-values, kind="stable")[:components]
    lines = lines[:, first]
    lines = lines * np.where(lines[np.abs(lines).argmax(axis=0), np.arange(len(first))] < 0, -1.0, 1.0)  # one sign, whatever the library's
    model = Whitening(n, sums, lines, values[first].tolist(), float(np.trace(covariance)))
    seen = [i for i, e in enumerate(model.variances) if e > NEGLIGIBLE * model.trace]
    scale = np.array([np.sqrt(e) if i in seen else np.inf for i, e in enumerate(model.variances)])
    model.projection = lines / scale
    if seen:
        shaped, middle = model.projection[:, seen], (left @ model.projection)[seen]

        def spread(x: np.ndarray) -> np.ndarray:
            w = centred(x, n, sums) @ shaped - middle
            return (w.T @ w).ravel()

        k = len(seen)
        model.identity_error = float(np.abs(_merged(vectors, dim, spread).reshape(k, k) / n - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``rows`` with ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    ``deviation`` is the exact sum over dimensions of (n * x - sum)^2; the arrays hold
    a value for each component, by falling variance.
    """
    spark = rows.sparkSession
    ship_package(spark)
    names = {"n": "long", "deviation": "decimal(38,0)", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}
    usable = rows.where(is_usable(named(vector)))
    vectors = usable.select(named(vector).cast("array<double>").alias("v"))
    dim = common_length(vectors)
    if dim is None:
        return unpacked(packed(usable), **{c: F.lit(None).cast(kind) for c, kind in names.items()})
    model = fit(vectors.where(F.size("v") == dim), dim, components)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("deviation decimal(38,0), whitened array<double>")
    def projected(lists: pa.Array) -> pa.Array:
        m = shared.value
        x = whole_numbers(_vectors(lists, dim))
        d = deviations(x, m.n, m.sums)
        squares = pa.array([Decimal(v) if v < 10**38 else None for v in squared_lengths(d)], pa.decimal128(38, 0))
        w = (d.astype(np.float64) / m.n) @ m.projection
        empty = np.broadcast_to(~m.projection.any(axis=0), w.shape)
        k = w.shape[1]
        values = pa.array(w.ravel(), mask=empty.ravel())
        return pa.StructArray.from_arrays([squares, pa.ListArray.from_arrays(pa.array(np.arange(0, k * (len(w) + 1), k), pa.int32()), values)], ["deviation", "whitened"])

    judged = packed(usable).where(F.size(field(vector)) == dim).withColumn("p", projected(field(vector).cast("array<double>")))
    explained = F.array(*(F.lit(e / model.trace if model.trace > 0 else None).cast("double") for e in model.variances))
    return unpacked(judged, n=F.lit(model.n).cast("long"), deviation=F.col("p.deviation"), whitened=F.col("p.whitened"), explained=explained, identity_error=F.lit(model.identity_error).cast("double"))

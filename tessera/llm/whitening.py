"""Whitening of embedding vectors from moments that are merged pairwise.

Entries become whole numbers, and every distinct vector counts once.  Each
partition of these reduces to a count, exact sums, a mean and the scatter about
that mean; two such summaries merge by Chan's formula, in a tree.  So nothing is
squared before it is centred, and no task holds more than one summary and a
block of vectors.  The driver only decomposes one covariance matrix.  A second
pass merges the moments of the whitened vectors the same way and tells how far
their covariance is from the identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tessera.llm.common import stored

#: Vectors that are centred and multiplied at once.
BLOCK = 4096
#: Eigenvalues below this share of the trace count as none.
FLAT = 1e-12


@dataclass
class Moments:
    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray


@dataclass
class Space:
    """What whitens vectors of one length."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray  #: dimensions x components, divided by the root of the eigenvalue; NaN where there is none
    explained: list[float | None]
    identity_error: float | None = None


def exact_sums(x: np.ndarray) -> list[int]:
    if np.abs(x.astype(np.float64)).max(initial=0) * len(x) < 2.0**62:
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


def moments_of(x: np.ndarray, sums: list[int] | None = None) -> Moments:
    mean = x.astype(np.float64).mean(axis=0) if sums is None else np.array([s / len(x) for s in sums])
    centred = x - mean
    return Moments(len(x), sums or [], mean, centred.T @ centred)


def merged(a: Moments | None, b: Moments) -> Moments:
    """Moments of two sets together: the scatters, and that of the two means about the common one."""
    if a is None:
        return b
    n, apart = a.n + b.n, b.mean - a.mean
    return Moments(n, [s + t for s, t in zip(a.sums, b.sums, strict=True)], a.mean + apart * (b.n / n), a.scatter + b.scatter + np.outer(apart, apart) * (a.n * (b.n / n)))


def merged_by_length(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    return a | {d: merged(a.get(d), m) for d, m in b.items()}


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors in an Arrow array of lists, in blocks."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        for at in range(0, len(rows), BLOCK):
            some = rows[at : at + BLOCK]
            yield some, values[starts[some][:, None] + np.arange(d)]


def _summaries(batches: Iterator[pa.RecordBatch], of: Callable[[np.ndarray], Moments]) -> Iterator[pa.RecordBatch]:
    total: dict[int, Moments] = {}
    for batch in batches:
        for _, x in matrices(batch.column(0)):
            if x.shape[1]:
                total = merged_by_length(total, {x.shape[1]: of(x)})
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["summary"])


def _reduced(fit: DataFrame, of: Callable[[np.ndarray], Moments]) -> dict[int, Moments]:
    """Moments by length of vector; summaries meet in a tree, not at the driver."""
    return fit.mapInArrow(partial(_summaries, of=of), "summary binary").rdd.map(lambda r: pickle.loads(r[0])).treeReduce(merged_by_length)


def space_of(m: Moments, components: int) -> Space:
    """Unit eigenvectors by falling eigenvalue; of either sign, that whose largest entry is positive."""
    values, vectors = np.linalg.eigh(m.scatter / m.n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = float(np.trace(m.scatter / m.n))
    real = values > FLAT * trace
    axes = np.where(real, vectors / np.sqrt(np.where(real, values, 1)), np.nan)
    return Space(m.n, m.sums, np.array([s / m.n for s in m.sums]), axes, [float(max(e, 0.0)) / trace if trace > 0 else None for e in values])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - S) ** 2 over the dimensions, exact; None beyond 63 bits."""
    bound = n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0)
    if bound * bound * max(len(sums), 1) < 1 << 62:
        apart = x * n - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = x.astype(object) * n - np.array(sums, object)
    return [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(axis=1)]


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """The entries, as doubles, times ``scale``, rounded down."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out;
    rows that repeat get their rows each, but count once in the fit.  Vectors of
    different lengths are spaces of their own, each with its own n and
    components; empty vectors have no component and so no row.  A component
    without variance has a null ``whitened`` and doesn't enter
    ``identity_error``.  A deviation beyond 63 bits is null.  Other columns are
    ignored, whatever their names; an empty table gives an empty result.  The
    id keeps its type and may be null.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col), scale).alias("x"))
    fit = stored(rows.select("x").distinct())
    spaces: dict[int, Space] = {}
    if not fit.isEmpty():
        found = _reduced(fit, lambda x: moments_of(x, exact_sums(x)))
        spaces = {d: space_of(m, components) for d, m in found.items()}
        shared = spark.sparkContext.broadcast(spaces)  # a mean and some axes for each length
        for d, m in _reduced(fit, lambda x: moments_of((x - shared.value[x.shape[1]].mean) @ np.nan_to_num(shared.value[x.shape[1]].axes))).items():
            real = ~np.isnan(spaces[d].axes).any(axis=0)
            if real.any():
                spaces[d].identity_error = float(np.abs((m.scatter / m.n - np.eye(len(real)))[np.ix_(real, real)]).max())
    shared = spark.sparkContext.broadcast(spaces)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [kind, IntegerType(), LongType(), LongType(), DoubleType(), DoubleType(), DoubleType()]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                if not x.shape[1]:
                    continue
                s = shared.value[x.shape[1]]
                z, k = (x - s.mean) @ s.axes, s.axes.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, s.n)),
                        pa.array(deviations(x, s.n, s.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                        pa.array(z.ravel(), pa.float64(), mask=np.isnan(z).ravel()), pa.array(s.explained * len(at), pa.float64()), pa.array([s.identity_error] * (len(at) * k), pa.float64()),
                    ],
                    names=names,
                )

    return rows.mapInArrow(project, StructType([StructField(n, t) for n, t in zip(names, kinds, strict=True)]))

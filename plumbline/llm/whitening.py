"""Whitening of embeddings from polarised variances.

The covariance of two dimensions is half of what the variance of their sum exceeds the two variances by.  So the job adds
up one kind of figure only, the squares of centred integers: for every dimension and for the sum of every two dimensions.
All sums are exact: values are fixed-point integers, centred as n*x - S with the table's own n and S, squared in limbs, and
added up per task and then by Spark as decimals.  The covariances are put together from exact integers, and eigh gives
the components.
"""
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import pick, stage

SCALE, OFFSET = 64, 1_000_000
#: Fixed-point entries beyond it saturate, so that sums of 2^60 of them are exact.
LIMIT = 1 << 56
LIMB = 30
EXACT = "decimal(38,0)"


def fixed_point(entry: Column) -> Column:
    scaled = F.floor(F.least(F.greatest(entry.cast("double") * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT))))
    return scaled.cast("long") + OFFSET


def fixed_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector has only finite entries and the table's most frequent length (of several, the longest)."""
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    good = vectors.where((F.size("embedding") > 0) & F.forall("embedding", finite))
    rows = stage(good.select("vec_id", F.transform("embedding", fixed_point).alias("x")), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d"))["d"]).first()[0]
    return rows.where(F.size("x") == (lengths or 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def squares(z: np.ndarray) -> list[int]:
    """Exact sum of squares of each column."""
    most = max(abs(int(z.max(initial=0))), abs(int(z.min(initial=0))))

    def added(products: np.ndarray) -> list[int]:  # of non-negative or small products below 2^62: high and low parts apart
        return [(h << 32) + low for h, low in zip((products >> 32).sum(0).tolist(), (products & 0xFFFFFFFF).sum(0).tolist())]

    if most < 1 << 31:
        return added(z * z)
    if most < 1 << 30 + LIMB:
        high, low = z >> LIMB, z & (1 << LIMB) - 1
        return [(a << 2 * LIMB) + (b << LIMB + 1) + c for a, b, c in zip(added(high * high), added(high * low), added(low * low))]
    return (z.astype(object) ** 2).sum(0).tolist()


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, as 64-bit integers where they fit."""
    middle = [s // n for s in sums]
    apart = max(max(int(m) - int(low), int(high) - int(m)) for m, low, high in zip(middle, x.min(0), x.max(0))) if len(x) else 0
    if n * (apart + 1) < 1 << 61:  # the sum of two still fits
        left = np.array([s - n * m for s, m in zip(sums, middle)], np.int64)
        return (x - np.array(middle, np.int64)) * np.int64(n) - left
    return x.astype(object) * n - np.array(sums, object)


def exact_sums(rows: DataFrame, parts, size: int) -> list[int]:
    """Sums over all rows of the lists of exact integers that ``parts`` makes of each batch's matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            found = parts(_matrix(batch))
            total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([str(t) for t in total])], ["at", "part"])

    sums = rows.mapInArrow(run, "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast(EXACT)).alias("total"))
    found = dict(sums.select("at", F.col("total").cast("string")).collect())  # one row per dimension or pair
    return [int(found[i]) for i in range(size)]


@dataclass(frozen=True)
class Whitening:
    """n, the sums S, the covariance as exact numerators over n^3, eigenvalues falling, and components as columns."""
    n: int
    sums: list[int]
    numerators: list[list[int]]
    values: np.ndarray
    components: np.ndarray
    trace: float


def fit(rows: DataFrame) -> Whitening | None:
    """From rows with ``x``; None without any."""
    first = rows.select(F.size("x")).first()
    if first is None:
        return None
    d, n = first[0], rows.count()
    sums = exact_sums(rows, lambda x: [(h << 32) + low for h, low in zip((x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist())], d)

    def variances(x: np.ndarray) -> list[int]:
        y = centred(x, n, sums)
        out = squares(y)
        for i in range(d - 1):
            out += squares(y[:, i:i + 1] + y[:, i + 1:])
        return out

    found = exact_sums(rows, variances, d * (d + 1) // 2)
    numerators, at = [[0] * d for _ in range(d)], d
    for i in range(d):
        numerators[i][i] = found[i]
        for j in range(i + 1, d):
            numerators[i][j] = numerators[j][i] = (found[at] - found[i] - found[j]) // 2  # polarisation; the difference is even
            at += 1
    cube = n ** 3
    values, vectors = np.linalg.eigh(np.array([[float(Fraction(c, cube)) for c in row] for row in numerators]))
    trace = float(Fraction(sum(numerators[i][i] for i in range(d)), cube))
    return Whitening(n, sums, numerators, values[::-1], vectors[:, ::-1], trace)


def _projected(x: np.ndarray, w: Whitening, axes: np.ndarray) -> np.ndarray:
    return (centred(x, w.n, w.sums) / w.n).astype(np.float64) @ axes


def float_sums(rows: DataFrame, parts, size: int) -> np.ndarray:
    """As exact_sums, of arrays of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += parts(_matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["at", "part"])

    found = dict(rows.mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part")).collect())
    return np.array([found.get(i, 0.0) for i in range(size)])


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = 32) -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    A null vector, an empty one, one with a null or non-finite entry, and one whose length is not the table's most frequent
    is dropped; without any left there are no rows.  Entries of 2^50 or more saturate.  deviation is exact, and null where it
    does not fit 64 bits.  Components without variance (under 1e-13 of the first: a single vector, equal vectors, dimensions that
    repeat each other) have no whitened value: it is null, and identity_error does not count them.  explained is null where nothing
    varies.  Repeated rows are repeated, a null vec_id stays; further columns are not read.
    What reaches the driver is of the size of the covariance matrix, whatever the number of rows.
    """
    rows = fixed_vectors(pick(vectors, vec_id=vec_id, embedding=embedding))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit(rows)
    if w is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = min(most, len(w.sums))
    varied = w.values[:k] > max(w.values[0], 0) * 1e-13
    axes = w.components[:, :k] / np.sqrt(np.where(varied, w.values[:k], 1.0))
    mean = float_sums(rows, lambda x: _projected(x, w, axes).sum(0), k) / w.n

    def products(x: np.ndarray) -> np.ndarray:
        apart = _projected(x, w, axes) - mean
        return (apart.T @ apart).ravel()

    covariance = float_sums(rows, products, k * k).reshape(k, k)[np.ix_(varied, varied)] / w.n
    error = float(np.abs(covariance - np.eye(len(covariance))).max(initial=0.0))
    explained = (w.values[:k] / w.trace).tolist() if w.trace else [None] * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                x, m = _matrix(batch), batch.num_rows
                out = _projected(x, w, axes)
                deviation = [v if v < 1 << 63 else None for v in squares(np.ascontiguousarray(centred(x, w.n, w.sums).T))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, w.n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                     pa.array(out.ravel(), mask=np.tile(~varied, m)), pa.array(explained * m, pa.float64()), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)

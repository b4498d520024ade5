"""Embedding whitening: exact sums and a centred scatter summed by Spark, cyclic Jacobi rotations on the driver, a broadcast matrix.

An entry c counts as the whole number x = floor(1024 * c) + 100000. With n vectors and sums S, y = n * x - S is exact, so
vectors are centred before anything is multiplied and nothing cancels; tasks add up y * y' / n^2 over their rows, Spark
adds up the tasks' triangles by place, and the driver sees d * (d + 1) / 2 numbers for d dimensions, whatever the rows.

Defined cases: a null vector, one with a null or non-finite entry and one whose x is no long are left out; so are vectors
of another length than most have (ties: the longer), and empty ones. Repeated rows and null ids count one by one. A
direction without spread (e is 0 to double precision, as for constant dimensions or fewer vectors than dimensions) has
whitened 0.0 and explained 0.0, and the identity error leaves it out (0.0 where nothing is left). A deviation beyond a
long is null. An empty table gives no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table

SCALE, SHIFT = 1024, 100_000
SWEEPS = 60
COMPONENTS = 8


class Spread(NamedTuple):
    """Of the fit list: number of vectors, sums by dimension (exact), eigenvalues (falling), unit eigenvectors as columns, trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole(batch: pa.RecordBatch, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their x, one row each) by length of the vectors, or for one length alone; the vector is the last column."""
    lists = batch.column(batch.num_columns - 1)
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for length in [size] if size else [int(s) for s in np.unique(lengths) if s]:
        rows = np.flatnonzero(lengths == length)
        c = flat[offsets[:-1][rows][:, None] + np.arange(length)] * SCALE
        # Nulls are nan here. Beyond 2^62 x would be no long.
        kept = (np.abs(c) < 2.0**62).all(axis=1)
        yield rows[kept], np.floor(c[kept]).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: Python's whole numbers stand in where a long could overflow."""
    most = max((abs(int(x.max())), abs(int(x.min())))) if x.size else 0
    if 2 * n * max(most, 1) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for _, x in whole(batch):
            n, before = totals.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
            small = len(x) == 0 or int(np.abs(x).max()) * len(x) < 1 << 62
            totals[x.shape[1]] = (n + len(x), before + (x if small else x.astype(object)).sum(axis=0))
        if len(totals) > 1000:
            yield from _rows(totals)
            totals = {}
    yield from _rows(totals)


def _rows(totals: dict) -> Iterator[pa.RecordBatch]:
    for size, (n, sums) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([size] * size), pa.array(np.arange(size)), pa.array([n] * size), pa.array([str(int(s)) for s in sums])], names=["size", "place", "n", "total"])


def _scatter(n: int, sums: list[int]):
    size = len(sums)
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for _, x in whole(batch, size):
                y = centred(x, n, sums).astype(np.float64) / n
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], names=["i", "j", "value"])

    return run


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations.

    A sweep meets each pair of dimensions once, in the order of a round-robin tournament, whose rounds of disjoint pairs
    are turned together. A pair is turned while its off-diagonal entry exceeds 2^-52 of the geometric mean of its
    diagonal entries, which keeps small eigenvalues of a positive matrix accurate in themselves, not only against the
    largest. An eigenvector's largest entry (the first of equals) is positive.
    """
    d = len(a)
    a, turned = np.array(a, np.float64), np.eye(d)
    even = d + d % 2
    seats = np.arange(even)
    for _ in range(SWEEPS):
        quiet = True
        for _ in range(max(0, even - 1)):
            p, q = seats[: even // 2], seats[even // 2 :][::-1]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            p, q = np.minimum(p, q), np.maximum(p, q)
            real = q < d
            p, q = p[real], q[real]
            off = a[p, q]
            big = np.abs(off) > 2.0**-52 * np.sqrt(np.abs(a[p, p] * a[q, q]))
            if not big.any():
                continue
            quiet = False
            p, q, off = p[big], q[big], off[big]
            tau = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            up, down = a[p, p] - t * off, a[q, q] + t * off
            for rows in (a, turned.T):
                x, y = rows[p], rows[q]
                rows[p], rows[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            x, y = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            a[p, p], a[q, q], a[p, q], a[q, p] = up, down, 0.0, 0.0
        if quiet:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    vectors = turned[:, order]
    if d:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return values[order], vectors


def vectors_of(df: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    return df.select(F.col(key).alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))


def fit(spark: SparkSession, vectors: DataFrame) -> Spread | None:
    """The spread of all vectors (vec_id, embedding array<double>); None where none remains. Two passes over the vectors."""
    small_batches(spark, 4096)
    parts = vectors.select("embedding").mapInArrow(_sums, "size long, place long, n long, total string")
    totals = table(parts.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")), "sums")
    first = totals.filter("place = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if first is None:
        return None
    sums = [int(r.total) for r in totals.filter(F.col("size") == first.size).orderBy("place").collect()]
    cells = vectors.select("embedding").mapInArrow(_scatter(first.n, sums), "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    v = np.zeros((len(sums), len(sums)))
    i, j, value = (c.to_numpy() for c in cells.columns)
    v[i, j] = v[j, i] = value / first.n
    return Spread(first.n, sums, *jacobi(v), float(np.trace(v)))


def whitening_matrix(spread: Spread, components: int) -> np.ndarray:
    """Columns that take x - S/n to whitened components; a direction without spread has zeros."""
    e = spread.values[:components]
    flat = e <= len(spread.sums) * 2.0**-52 * max(float(spread.values[0]), 0.0)
    return np.where(flat, 0.0, spread.vectors[:, :components] / np.sqrt(np.where(flat, 1.0, e)))


def whiten(spark: SparkSession, vectors: DataFrame, spread: Spread, components: int | None = None) -> DataFrame:
    """vec_id, deviation long, whitened array<double> of every vector kept; the matrix (d * components doubles) is broadcast."""
    small_batches(spark, 4096)
    n, sums = spread.n, spread.sums
    shared = spark.sparkContext.broadcast(whitening_matrix(spread, components or len(sums)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole(batch, len(sums)):
                y = centred(x, n, sums)
                real = y.astype(np.float64)
                far = (real * real).sum(axis=1) >= 2.0**62
                squares = np.zeros(len(y), object)
                squares[~far] = (y[~far] * y[~far]).sum(axis=1)
                squares[far] = (y[far].astype(object) ** 2).sum(axis=1)
                deviation = [None if s >= 1 << 63 else int(s) for s in squares]
                out = real / n @ shared.value
                lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, spread: Spread, components: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance (centred, divisor n) minus the identity, over directions with spread."""
    kept = np.flatnonzero(whitening_matrix(spread, components).any(axis=0)).tolist()
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    if not pairs:
        return 0.0
    w = F.col("whitened")
    row = whitened.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


SHAPE = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def report(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row a remaining vector and component."""
    spread = fit(spark, vectors)
    if spread is None:
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {SHAPE}")
    components = min(components, len(spread.sums))
    rows = whiten(spark, vectors, spread, components)
    error = identity_error(rows, spread, components)
    share = [float(max(e, 0.0) / spread.trace) if spread.trace > 0 else 0.0 for e in spread.values[:components]]
    told = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return told.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(spread.n).cast("long").alias("n"), "deviation", "whitened", F.array(*map(F.lit, share))[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, vectors_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))

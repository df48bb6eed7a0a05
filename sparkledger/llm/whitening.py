"""Operator 13: embedding whitening by a compensated covariance and a divide-and-conquer eigen-solve.

Entries become integers x = floor(64 * entry) + 1000000, so counts, sums and deviations are exact. The covariance is taken from centred rows:
each block of rows is cut into slices of few bits, whose matrix products are exact in double precision (the error-free transformation of a matrix
product), and these products are added in double-double, high and low parts, by error-free sums. Tasks send a high and a low part each, which
are merged in two rounds, in the order of the tasks. The one table that reaches the driver is the covariance (dimensions squared, whatever the
number of rows); its eigenvectors come from LAPACK's tridiagonal divide-and-conquer solver (`syevd`, through numpy.linalg.eigh).

Rows whose vector is null, of another length than the most frequent one, or holds null or non-finite entries are dropped. Ids are carried as they
are, nulls and repeated ones too; repeated rows count each time. Along components without variance, whitened is null; identity_error is taken over the
others and null if there is none. An empty table gives no rows. Entries of 2^34 and more, and deviations beyond a long, are errors. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

COMPONENTS = 32
SHIFT, SCALE = 1_000_000, 64
#: Rows of an exact block product: two slices of 22 bits and the sum over so many rows fit in 53 bits.
BLOCK, BITS = 512, 22
#: Groups in which the parts of tasks are merged first, and entries of the matrix in a part.
MERGERS, PART = 64, 1 << 16


def units(found: np.ndarray) -> np.ndarray:
    x = np.floor(found * SCALE)
    if x.size and np.abs(x).max() >= 2.0**40:
        raise ValueError("entries of 2^34 and more can't be counted exactly")
    return x.astype(np.int64) + SHIFT


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b, rounded, and what the rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(hi: np.ndarray, lo: np.ndarray, more_hi: np.ndarray, more_lo: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles."""
    s, e = two_sum(hi, more_hi)
    e += lo + more_lo
    return two_sum(s, e)


def slices(c: np.ndarray) -> list[np.ndarray]:
    """c as a sum of matrices whose columns are multiples of one power of two with BITS bits at most; nothing is lost."""
    out = []
    while c.any():
        _, high = np.frexp(np.abs(c).max(axis=0))
        grid = np.ldexp(0.75 * 4, high + 52 - BITS)  # adding and taking it away leaves the leading bits
        top = (c + grid) - grid
        out.append(top)
        c = c - top
    return out


def gram(c: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds the sum of the rows' outer products."""
    for i in range(0, len(c), BLOCK):
        parts = slices(c[i : i + BLOCK])
        for a in parts:
            for b in parts:
                hi, lo = add(hi, lo, a.T @ b)
    return hi, lo


def covariance(df: DataFrame, col: str, dim: int, n: int, size: int, rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the outer products of rows(vectors), over n; size: entries of a row."""
    width = max(1, PART // size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, lo = np.zeros((size, size)), np.zeros((size, size))
        for batch in batches:
            hi, lo = gram(rows(V.matrix(batch.column(0), dim)[1]), hi, lo)
        task = TaskContext.get().partitionId()
        at = list(range(0, size, width))
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * len(at), pa.int64()), pa.array([a // width for a in at], pa.int64()), *(pa.array([x[a : a + width].ravel() for a in at], pa.list_(pa.float64())) for x in (hi, lo))], names=["task", "part", "hi", "lo"]
        )

    def merge(key, parts):
        parts = parts.sort_values("task")
        hi = lo = np.zeros(len(parts.hi.iloc[0]))
        for h, e in zip(parts.hi, parts.lo):
            hi, lo = add(hi, lo, h, e)
        return type(parts)({"task": [parts.task.min()], "part": [parts.part.iloc[0]], "hi": [hi], "lo": [lo]})

    schema = "task long, part long, hi array<double>, lo array<double>"
    found = df.select(col).mapInArrow(sums, schema)
    found = found.groupBy("part", F.pmod("task", F.lit(MERGERS))).applyInPandas(merge, schema).groupBy("part").applyInPandas(merge, schema)
    hi = np.concatenate([np.add(r.hi, r.lo) for r in found.orderBy("part").collect()])
    return hi.reshape(size, size) / n


def totals(df: DataFrame, col: str, dim: int) -> tuple[int, list[int]]:
    """The number of vectors that take part and their sums by dimension, exact."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, np.zeros(dim, np.int64), 0
        for batch in batches:
            x = units(V.matrix(batch.column(0), dim)[1])
            if most + len(x) * (top := int(np.abs(x).max(initial=0))) >= 1 << 62:
                yield _row(n, total)
                n, total, most = 0, np.zeros(dim, np.int64), 0
            n, total, most = n + len(x), total + x.sum(axis=0), most + len(x) * top
        yield _row(n, total)

    def _row(n, total):
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], total])], pa.list_(pa.int64()))], names=["sums"])

    each = df.select(col).mapInArrow(sums, "sums array<long>").select(F.posexplode("sums").alias("dim", "x"))
    found = each.groupBy("dim").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).orderBy("dim").collect()
    return int(found[0].x), [int(r.x) for r in found[1:]]


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, and the sum of its squares over the dimensions; both are exact, as they fit in 64 bits."""
    if n * max(float(np.abs(x).max(initial=0)), float(np.abs(sums / n).max(initial=0))) >= 2.0**63:
        raise OverflowError("n * x is beyond a long")
    d = n * x - sums
    if (np.square(d.astype(float)).sum(axis=1) >= 2.0**63 * (1 - 1e-12)).any():
        raise OverflowError("a deviation is beyond a long")
    return d, (d * d).sum(axis=1)


def directions(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive. Eigenvalues within rounding of zero are zero."""
    e, vectors = np.linalg.eigh((cov + cov.T) / 2)
    e, vectors = e[::-1][:components], vectors[:, ::-1][:, :components]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])
    return np.where(e > len(cov) * np.finfo(float).eps * max(np.trace(cov), 0), e, 0.0), vectors


def whiten(df: DataFrame, id_col: str = "vec_id", col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: id_col, component, n, deviation, whitened, explained, identity_error."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    df = df.select(id_col, col)
    C.small_batches(df.sparkSession)
    dim = V.width(df, col)
    n, sums = totals(df, col, dim) if dim else (0, [])
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    total = np.array(sums, np.int64)

    def centred(found: np.ndarray) -> np.ndarray:
        return deviations(units(found), n, total)[0] / float(n)

    cov = covariance(df, col, dim, n, dim, centred)
    e, vectors = directions(cov, components)
    spread = e > 0
    scaled = vectors[:, spread] / np.sqrt(e[spread])
    trace = float(np.trace(cov))
    explained = [float(x) / trace if trace > 0 else None for x in e]
    error = float(np.abs(covariance(df, col, dim, n, int(spread.sum()), lambda found: centred(found) @ scaled) - np.eye(int(spread.sum()))).max()) if spread.any() else None
    k = len(e)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = V.matrix(batch.column(1), dim)
            d, deviation = deviations(units(found), n, total)
            white = np.full((len(at), k), np.nan)
            white[:, spread] = (d / float(n)) @ scaled
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * k, n, np.int64)),
                    pa.array(np.repeat(deviation, k)),
                    pa.array(white.ravel(), pa.float64(), from_pandas=True),
                    pa.array(explained * len(at), pa.float64()),
                    pa.array([error] * (len(at) * k), pa.float64()),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return df.mapInArrow(write, schema)

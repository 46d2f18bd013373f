"""Whitening of embeddings by principal components, from variances alone.

Entries become whole numbers x = floor(64 c) + 1000000. Four passes over the vectors, none with a shuffle of vectors:

1. the number n of vectors and the sums S of each dimension;
2. exact sums of squares, centred at the whole number m next to the mean, of every dimension (z = x - m) and of every sum of two
   dimensions (z_i + z_j). With r = S - n m, n^2 var(i) = n sum z^2 - r^2 holds exactly; the same for pairs, and polarisation gives
   n^2 cov(i, j) = (n^2 var(i + j) - n^2 var(i) - n^2 var(j)) / 2. The matrix goes to ``eigh`` on the driver: dimension^2 numbers, whatever the rows;
3. the covariance of the whitened rows, for ``identity_error``;
4. the output.

Sums are 64-bit whole numbers as long as that is provably enough, else unlimited ones; tasks hand them over as decimals. Batches are cut so that
rows x pairs stays under ``CELLS``.

Defined cases: vectors that are null, empty or hold null or non-finite entries are dropped; of the rest, the most frequent length (of equally
frequent ones the longest) is the table's dimension, other lengths are dropped too. Components whose eigenvalue is zero to double precision
cannot be scaled to one and are left out, so a table of equal vectors gives no rows, nor does an empty one. A component's sign makes its
largest entry positive. Null and repeated ids keep their rows. Entries of 2^56 or more raise an error, as they have no 64-bit form; a deviation
beyond 64 bits (from about 4e7 vectors of length one on) is null, the other columns stay exact. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
CELLS = 1 << 21
SAFE = 1 << 62
OFFSET = 1_000_000


def _sound(vectors: DataFrame) -> DataFrame:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return x.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", finite))


def _whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    v = np.floor(64.0 * np.asarray(batch.column("v").flatten(), dtype=np.float64))
    if (np.abs(v) >= SAFE).any():
        raise OverflowError("an entry of 2^56 or more has no 64-bit form")
    return v.astype(np.int64).reshape(-1, d) + OFFSET


def _slices(batches: Iterator[pa.RecordBatch], d: int, cells: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, CELLS // cells)
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield part, _whole(part, d)


def _sums(batches: Iterator[np.ndarray], width: int) -> list[int]:
    """Column sums of arrays of whole numbers given with a bound: exact, in 64 bits while the bounds allow it."""
    total, running, room = [0] * width, np.zeros(width, dtype=np.int64), SAFE
    for values, bound in batches:
        if bound > room:
            total = [a + int(b) for a, b in zip(total, running, strict=True)]
            running, room = np.zeros(width, dtype=np.int64), SAFE
        if bound > room:
            total = [a + sum(map(int, col)) for a, col in zip(total, values.T, strict=True)]
        else:
            running += values.sum(0)
            room -= bound
    return [a + int(b) for a, b in zip(total, running, strict=True)]


def _emit(values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), type=pa.int64()), pa.array([Decimal(v) for v in values], type=pa.decimal128(38, 0))], names=["k", "s"])


def _collected(parts: DataFrame, width: int) -> list[int]:
    """The tasks' sums added up: one row per cell of a matrix whose size is the dimension's, not the table's."""
    found = {r["k"]: int(r["s"]) for r in parts.groupBy("k").agg(F.sum("s").alias("s")).collect()}
    return [found.get(k, 0) for k in range(width)]


def _square(z: np.ndarray) -> np.ndarray:
    """Squares of every column and of every sum of two columns."""
    i, j = np.triu_indices(z.shape[1], 1)
    return np.concatenate([z, z[:, i] + z[:, j]], axis=1) ** 2


@dataclass(frozen=True)
class Whitening:
    n: int
    centre: np.ndarray  # whole number next to the mean of each dimension
    rest: list[int]  # S - n * centre
    covariance: np.ndarray
    values: np.ndarray  # eigenvalues of the components, falling
    vectors: np.ndarray  # their unit vectors, as columns

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([r / self.n for r in self.rest])
        return ((x - self.centre) - mean) @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum over dimensions of (n x - S)^2, null beyond 64 bits."""
        z, d = x - self.centre, x.shape[1]
        most, off = int(np.abs(z).max(initial=0)), max(map(abs, self.rest), default=0)
        if d * (self.n * most + off) ** 2 < SAFE:
            return ((self.n * z - np.array(self.rest, dtype=np.int64)) ** 2).sum(1).tolist()
        out = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in z.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def covariance_of(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """Polarisation, in whole numbers until the last division."""
    d = len(rest)
    one = [n * squares[k] - rest[k] ** 2 for k in range(d)]
    out = np.diag([v / n**2 for v in one])
    for k, (i, j) in enumerate(zip(*(x.tolist() for x in np.triu_indices(d, 1)), strict=True)):
        both = n * squares[d + k] - (rest[i] + rest[j]) ** 2
        out[i, j] = out[j, i] = (both - one[i] - one[j]) // 2 / n**2
    return out


def _sized(vectors: DataFrame, d: int) -> DataFrame:
    return _sound(vectors).where(F.size("v") == d)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all sound vectors; None if there are none."""
    length = _sound(vectors).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return None
    d, n = length["d"], length["n"]
    rows, pairs = _sized(vectors, d).select("v"), d * (d + 1) // 2

    def sums(batches):
        yield _emit(_sums(((x, len(x) * int(np.abs(x).max())) for _, x in _slices(batches, d, d)), d))

    total = _collected(rows.mapInArrow(sums, "k bigint, s decimal(38,0)"), d)
    middle = [(2 * s + n) // (2 * n) for s in total]
    centre, rest = np.array(middle, dtype=np.int64), [s - n * m for s, m in zip(total, middle, strict=True)]

    def squares(batches):
        def each():
            for _, x in _slices(batches, d, pairs):
                z = x - centre
                bound = 4 * int(np.abs(z).max()) ** 2
                yield _square(z if bound < SAFE else z.astype(object)), bound * len(z)

        yield _emit(_sums(each(), pairs))

    v = covariance_of(n, rest, _collected(rows.mapInArrow(squares, "k bigint, s decimal(38,0)"), pairs))
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    k = min(components, int((values > d * np.finfo(float).eps * max(values[0], 0.0)).sum()))
    values, vectors_ = values[:k], vectors_[:, :k]
    sign = np.sign(vectors_[np.abs(vectors_).argmax(0), np.arange(k)])
    return Whitening(n, centre, rest, v, values, vectors_ * sign)


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from the rows."""
    d, k = len(w.rest), len(w.values)

    def products(batches):
        total = np.zeros(k * k + k)
        for _, x in _slices(batches, d, d):
            y = w.project(x)
            total += np.concatenate([(y.T @ y).ravel(), y.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), type=pa.int64()), pa.array(total)], names=["k", "s"])

    parts = _sized(vectors, d).select("v").mapInArrow(products, "k bigint, s double").groupBy("k").agg(F.sum("s").alias("s"))
    found = np.array([r["s"] for r in sorted(parts.collect())]) / w.n
    mean = found[k * k:]
    return float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each sound vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double"
    w = fit(vectors, components)
    if w is None or not len(w.values):
        return vectors.sparkSession.createDataFrame([], schema + ", identity_error double")
    d, k, share = len(w.rest), len(w.values), w.values / w.covariance.trace()

    def rows(batches):
        for b, x in _slices(batches, d, max(d, k)):
            m, ids = len(x), b.column("vec_id")
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, dtype=np.int64)),
                pa.array(w.deviations(x), type=pa.int64()).take(each), pa.array(w.project(x).ravel()), pa.array(np.tile(share, m))], names=[c.split()[0] for c in schema.split(", ")])

    return _sized(vectors, d).mapInArrow(rows, schema).withColumn("identity_error", F.lit(identity_error(vectors, w)))

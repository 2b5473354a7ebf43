"""Whitening of embeddings: principal components of unit variance.

Entries are taken in whole steps, x = floor(64 c) + OFFSET. The covariance is gathered by
Welford's streaming updates: a task goes through its vectors and adds for each the
rank-one matrix (x - mean before) (x - mean after)^T, so nothing is squared that isn't
centred; the updates of a block of rows are summed in one product. States of tasks
(count, mean, matrix of dims^2 numbers) are merged by the parallel update formula, at most
FAN of them in one task, in as many rounds as it takes. The driver gets the one state that
is left, dims^2 numbers whatever the number of rows, and solves it by the symmetric
QR method: Householder reflections to a tridiagonal matrix, then implicit QR steps with
Wilkinson shifts. Sums of x are whole numbers kept in two halves, so they are exact
at any count. A second pass gathers the covariance of the whitened vectors the same way,
and a third gives the rows; tasks get the mean and the components, bounded by dims.

Defined results: rows whose vector is null or holds a null or non-finite entry are left
out; repeated rows each count; a null vec_id stays null; missing entries of shorter
vectors count as 0, an empty vector as all 0; entries beyond 2^46 count as 2^46. Components
whose variance is nil to double precision (one vector, equal vectors, more components than
dimensions with spread) have no whitened value and give no rows; an empty table gives none.
``deviation`` is exact to 38 digits. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import Scratch, table

#: Steps a unit, and what the contract adds to them; it cancels in all that is returned, so y = x - OFFSET is what is summed.
STEPS, OFFSET = 64, 1_000_000
#: Rows whose rank-one updates are summed in one product, states merged in one task, rows of vectors given out at once.
BLOCK, FAN, OUT_ROWS = 512, 16, 1024
STATE = "n long, dims int, high binary, low binary, mean binary, m2 binary"
HALF = 31


@dataclass
class State:
    """Welford's running count, exact sums (high * 2^31 + low), mean and centred second moments."""

    n: int
    high: np.ndarray
    low: np.ndarray
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def of(cls, dims: int) -> State:
        return cls(0, np.zeros(dims, np.int64), np.zeros(dims, np.int64), np.zeros(dims), np.zeros((dims, dims)))

    def widened(self, dims: int) -> State:
        """More dimensions, in which all rows so far are 0."""
        more = max(0, dims - self.mean.size)
        return self if not more else State(self.n, np.pad(self.high, (0, more)), np.pad(self.low, (0, more)), np.pad(self.mean, (0, more)), np.pad(self.m2, ((0, more), (0, more))))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update for each row in turn: mean += (x - mean) / n, m2 += (x - old mean) (x - new mean)^T."""
        if rows.dtype == np.int64:
            self.high += (rows >> HALF).sum(0)
            self.low += (rows & ((1 << HALF) - 1)).sum(0)
        for lo in range(0, len(rows), BLOCK):
            away = rows[lo : lo + BLOCK] - self.mean  # small numbers, so their running sums lose nothing
            seen = self.n + np.arange(1, len(away) + 1)[:, None]
            after = np.cumsum(away, 0) / seen
            before = np.vstack([np.zeros((1, after.shape[1])), after[:-1]])
            self.m2 += (away - before).T @ (away - after)
            self.mean = self.mean + after[-1]
            self.n += len(away)

    def merge(self, other: State) -> State:
        """The parallel update: moments add up, with the rank-one matrix of the difference of means."""
        dims = max(self.mean.size, other.mean.size)
        a, b = self.widened(dims), other.widened(dims)
        if not a.n or not b.n:
            return a if a.n else b
        n, d = a.n + b.n, b.mean - a.mean
        high, low = a.high + b.high, a.low + b.low
        return State(n, high + (low >> HALF), low & ((1 << HALF) - 1), a.mean + d * (b.n / n), a.m2 + b.m2 + np.outer(d, d) * (a.n * (b.n / n)))

    def sums(self) -> list[int]:
        return [int(h) * (1 << HALF) + int(x) for h, x in zip(self.high, self.low, strict=True)]

    def covariance(self) -> np.ndarray:
        return (self.m2 + self.m2.T) / (2 * self.n)

    def batch(self) -> pa.RecordBatch:
        parts = [pa.array([x.tobytes()], pa.binary()) for x in (self.high, self.low, self.mean, self.m2)]
        return pa.RecordBatch.from_arrays([pa.array([self.n], pa.int64()), pa.array([self.mean.size], pa.int32()), *parts], ["n", "dims", "high", "low", "mean", "m2"])

    @classmethod
    def read(cls, n: int, dims: int, high: bytes, low: bytes, mean: bytes, m2: bytes) -> State:
        ints, floats = (lambda b: np.frombuffer(b, np.int64)), (lambda b: np.frombuffer(b, np.float64))
        return cls(n, ints(high), ints(low), floats(mean), floats(m2).reshape(dims, dims))


def steps(c: Column) -> Column:
    """floor(64 c) of each entry as a long; null if an entry is null or not finite, or the vector is."""
    ok = ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    most = float(1 << 52)
    whole = F.transform(c, lambda x: F.floor(F.least(F.greatest(F.lit(float(STEPS)) * x.cast("double"), F.lit(-most)), F.lit(most))).cast("long"))
    return F.when(F.coalesce(ok, F.lit(False)), whole)


def matrix(lists: pa.Array, dims: int = 0) -> np.ndarray:
    """Rows of a list column, shorter ones filled with 0."""
    flat, offs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), lists.offsets.to_numpy().astype(np.int64)
    offs, size = offs - offs[0], np.diff(offs)
    out = np.zeros((len(lists), max(dims, int(size.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(size.size), size), np.arange(flat.size) - np.repeat(offs[:-1], size)] = flat
    return out


def gathered(vectors: DataFrame, scratch: Scratch, project=None) -> State | None:
    """The state of all rows of ``vectors`` (v), or of their projections; None without rows."""

    def run(batches):
        state = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 8 * BLOCK):
                rows = matrix(batch.column(0).slice(lo, 8 * BLOCK))
                rows = project(rows) if project else rows
                state = (state or State.of(rows.shape[1])).widened(rows.shape[1])
                state.add(rows if rows.shape[1] == state.mean.size else np.pad(rows, ((0, 0), (0, state.mean.size - rows.shape[1]))))
        if state:
            yield state.batch()

    def merged(batches):
        state = None
        for batch in batches:
            for r in batch.to_pylist():
                one = State.read(**r)
                state = state.merge(one) if state else one
        if state:
            yield state.batch()

    states = scratch.written(vectors.select("v").mapInArrow(run, STATE))
    left = states.count()  # one a task
    while left > 1:
        left = -(-left // FAN)
        states = scratch.written(states.repartition(left).mapInArrow(merged, STATE))
        left = states.count()
    found = states.first()
    return State.read(*found) if found else None


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and Q with a = Q T Q^T, by Householder reflections; entries of ``a`` are 1 at most."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if np.abs(v[1:]).max() < 1e-32:  # nothing, beside entries of up to 1
            continue
        size = np.linalg.norm(v)
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, by implicit QR steps with Wilkinson shifts."""
    scale = float(np.abs(a).max(initial=0)) or 1.0
    d, e, q = tridiagonal(a / scale)
    q, eps, end = np.ascontiguousarray(q.T), np.finfo(float).eps, len(d) - 1
    while end > 0:
        small = np.abs(e[:end]) <= eps * (np.abs(d[:end]) + np.abs(d[1 : end + 1])) / 2 + eps * eps
        if small[end - 1]:
            end -= 1
            continue
        begin = int(np.flatnonzero(small)[-1]) + 1 if small.any() else 0
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + np.copysign(np.hypot(half, e[end - 1]), half))
        x, z = d[begin] - shift, e[begin]
        for k in range(begin, end):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > begin:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < end - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k : k + 2] = np.array([[c, s], [-s, c]]) @ q[k : k + 2]
    order = np.argsort(-d, kind="stable")
    return d[order] * scale, (q / np.linalg.norm(q, axis=1)[:, None])[order].T


@dataclass
class Model:
    """n and whole sums S of the fit list, and its components with variance: unit vectors, variances, shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    shares: np.ndarray

    def whiten(self, rows: np.ndarray) -> np.ndarray:
        """(y - S / n) on each component over the root of its variance; the whole part of the mean is taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((rows - whole).astype(float) - rest) @ (self.vectors / np.sqrt(self.variances))

    def deviation(self, rows: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n y - S)^2 for each row, exact."""
        far = self.n * int(np.abs(rows).max(initial=0)) + max(map(abs, self.sums), default=0)
        if far < 1 << 62:
            d = self.n * rows - np.array(self.sums, np.int64)
            if int(np.abs(d).max(initial=0)) ** 2 * max(1, rows.shape[1]) < 1 << 63:
                return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
        d = self.n * rows.astype(object) - np.array(self.sums, object)
        return pa.array([Decimal(int(x)) for x in (d * d).sum(1)], pa.decimal128(38, 0))


def fit(vectors: DataFrame, scratch: Scratch, most: int) -> Model | None:
    """The first ``most`` components of ``vectors`` (v); None without rows."""
    state = gathered(vectors, scratch)
    if state is None:
        return None
    e, q = symmetric_qr(state.covariance())
    trace = float(np.trace(state.covariance()))
    # An entry of the covariance carries an error of some eps * its size, a component below that is noise.
    real = int(np.count_nonzero(e > max(1, e.size) * np.finfo(float).eps * max(float(e.max(initial=0)), 0))) if trace > 0 else 0
    k = min(most, real)
    return Model(state.n, state.sums(), np.ascontiguousarray(q[:, :k]), e[:k], e[:k] / trace if k else e[:k])


OUT = "vec_id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened(df: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and component."""
    scratch = Scratch(df.sparkSession)
    vectors = df.select(F.col(key).alias("vec_id"), steps(F.col(vector)).alias("v")).where(F.col("v").isNotNull())
    schema = OUT.format(df.schema[key].dataType.simpleString())
    model = fit(vectors, scratch, components)
    k = model.variances.size if model else 0
    if not k:
        scratch.drop()
        return df.sparkSession.createDataFrame([], schema)
    dims = len(model.sums)
    project = lambda rows: model.whiten(np.pad(rows, ((0, 0), (0, dims - rows.shape[1]))))
    error = float(np.abs(gathered(vectors, scratch, project).covariance() - np.eye(k)).max())
    scratch.drop()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(lo, OUT_ROWS)
                rows, m = matrix(part.column(1), dims), part.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), model.deviation(rows).take(each),
                        pa.array(model.whiten(rows).ravel()), pa.array(np.tile(model.shares, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(run, schema)


def op13_whitening(spark, sf_dir):
    """All ``embeddings``, 32 components; a deviation beyond a long, possible from some ten million vectors on, is null."""
    out = whitened(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))

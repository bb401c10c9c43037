"""Embedding whitening by incremental eigendecomposition.

Every partition keeps the spectrum of what it has read: count, mean, eigenvectors and eigenvalues of the
scatter about the mean. A vector is a centred rank-one update: the new eigenvalues are the roots of a secular
equation, after deflation of directions that the vector does not touch and of equal eigenvalues. Two spectra
are combined by successive rank-one updates, one for each direction of the smaller one and one for the
distance of the means, in a tree of tasks. A distributed Rayleigh-Ritz step with the basis so found gives the
components to double precision, whatever the updates have lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Spectra that one task combines at each level of the tree.
FAN_IN = 16
#: Embeddings become whole numbers: floor(SCALE * c) + SHIFT, within +- LARGEST.
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 52
EPS = np.finfo(float).eps
SPECTRUM = "count long, mean array<double>, values array<double>, vectors array<double>"


@dataclass
class Spectrum:
    """Eigendecomposition of a scatter about its mean; eigenvectors are columns, eigenvalues ascend."""

    count: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray, times: int = 1) -> None:
        """Take in a vector that occurs ``times`` times."""
        delta = x - self.mean
        total = self.count + times
        self.values, self.vectors = rank_one(self.values, self.vectors, delta, self.count * times / total)
        self.mean = self.mean + delta * (times / total)
        self.count = total

    def merge(self, other: Spectrum) -> None:
        """Take in another spectrum."""
        if not other.count:
            return
        delta = other.mean - self.mean
        total = self.count + other.count
        for value, vector in zip(other.values, other.vectors.T):
            self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        self.values, self.vectors = rank_one(self.values, self.vectors, delta, self.count * other.count / total)
        self.mean = self.mean + delta * (other.count / total)
        self.count = total

    def row(self) -> tuple:
        return self.count, self.mean.tolist(), self.values.tolist(), self.vectors.ravel().tolist()

    @classmethod
    def of(cls, count: int, mean, values, vectors) -> Spectrum:
        size = len(mean)
        return cls(count, np.array(mean), np.array(values), np.array(vectors).reshape(size, size))


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z2 / (d - t)) = 0`` for strictly ascending ``d``: nearest pole and distance from it.

    Root i lies between pole i and the next. Every root is sought from the pole on its half of the interval,
    so its distances to all poles keep their digits. Each step interpolates the sums of the poles on either
    side by one pole each; a step that leaves the bracket halves it instead.
    """
    n = len(d)
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    gap = upper - d
    apart = d[None, :] - d[:, None]
    weight = rho * z2
    lower_weight = np.tri(n) * weight
    middle = 1 + (weight / (apart - gap[:, None] / 2)).sum(1)
    # The last interval ends at no pole, so its root is sought from its own.
    base = np.arange(n) + ((middle < 0) & (np.arange(n) < n - 1))
    from_base = d[None, :] - d[base][:, None]
    here, there = d - d[base], upper - d[base]
    half = (here + there) / 2
    # f ascends from pole to pole: below 0 left of the root.
    low, high = np.where(middle < 0, half, here), np.where(middle < 0, there, half)
    t = (low + high) / 2
    left_pole, right_pole = here, there
    for _ in range(80):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            inverse = np.reciprocal(from_base - t[:, None])
            square = inverse * inverse
            psi, dpsi = np.einsum("ij,ij->i", inverse, lower_weight), np.einsum("ij,ij->i", square, lower_weight)
            phi, dphi = inverse @ weight - psi, square @ weight - dpsi
            f = 1 + psi + phi
            done = np.abs(f) <= 16 * EPS * (1 + np.abs(psi) + np.abs(phi)) * n
            low, high = np.where(f < 0, t, low), np.where(f > 0, t, high)
            done |= high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
            if done.all():
                break
            # psi ~ r + s / (left - t) and phi ~ u + v / (right - t), equal in value and slope at t.
            a, b = left_pole - t, right_pole - t
            s, v = dpsi * a * a, dphi * b * b
            c = 1 + (psi - dpsi * a) + (phi - dphi * b)
            # c (a - x)(b - x) + s (b - x) + v (a - x) = 0 for the step x.
            p, q = -(c * (a + b) + s + v), c * a * b + s * b + v * a
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            far = -(p + np.copysign(root, p)) / 2
            one, two = far / c, q / far
            step = np.where((t + two > low) & (t + two < high), two, one)
            step = np.where((t + step > low) & (t + step < high), step, (low + high) / 2 - t)
        t = np.where(done, t, t + np.where(np.isfinite(step), step, (low + high) / 2 - t))
    return base, t


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigendecomposition of ``vectors diag(values) vectors.T + rho v v.T``, eigenvalues ascending."""
    z = v @ vectors
    norm2 = float(z @ z)
    if not rho * norm2 > 0:
        return values, vectors
    z = z / np.sqrt(norm2)
    rho = rho * norm2
    tol = 8 * EPS * max(abs(values[-1]), abs(values[0]), rho)
    vectors = vectors.copy()
    # Equal eigenvalues: turn their directions so that the update touches the first of them alone.
    cut = np.flatnonzero(np.diff(values) > tol) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(values)]):
        if b - a > 1 and np.abs(z[a + 1 : b]).max() > 0:
            w = z[a:b].copy()
            size = np.sqrt(w @ w)
            w[0] += np.copysign(size, w[0])
            vectors[:, a:b] -= np.outer(vectors[:, a:b] @ w, w) * (2 / (w @ w))
            z[a], z[a + 1 : b] = -np.copysign(size, z[a]), 0
    live = np.flatnonzero(rho * np.abs(z) > tol)
    if len(live):
        d, zl = values[live], z[live]
        base, t = secular_roots(d, zl * zl, rho)
        away = (d[None, :] - d[base][:, None]) - t[:, None]  # pole j less root i
        # The update for which these roots are exact: its vectors are orthogonal whatever the roots' errors.
        ratio = -away
        gaps = d[:, None] - d[None, :]
        np.fill_diagonal(gaps, 1)
        # |z_j|^2 = prod_i (root_i - d_j) / prod_(i != j) (d_i - d_j) / rho, by logarithms of the factors.
        logs = np.log(np.abs(ratio) + np.finfo(float).tiny).sum(0) - np.log(np.abs(gaps)).sum(0)
        exact = np.sqrt(np.exp(logs) / rho) * np.sign(zl)
        with np.errstate(divide="ignore", invalid="ignore"):
            q = exact[None, :] / away
        stuck = ~np.isfinite(q).all(1)
        for i in np.flatnonzero(stuck):
            q[i] = (np.arange(len(d)) == base[i]).astype(float)
        q /= np.sqrt((q * q).sum(1))[:, None]
        values = values.copy()
        values[live] = d[base] + t
        vectors[:, live] = vectors[:, live] @ q.T
        order = np.argsort(values, kind="stable")
        values, vectors = values[order], vectors[:, order]
    return values, vectors


def whole_numbers(vectors: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``row`` (struct of ``keep``) and whole numbers ``x`` of the rows without null or non-finite entries.

    Of vectors with different numbers of entries those with the most frequent number stay, of equally
    frequent ones the largest; one with no entries has no component and goes.
    """
    entries = F.col(column).cast("array<double>")
    good = F.size(entries) > 0
    good = good & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(entries, lambda c: F.greatest(F.least(F.floor(F.least(F.greatest(c * SCALE, F.lit(-2.0 * LARGEST)), F.lit(2.0 * LARGEST))), F.lit(LARGEST)), F.lit(-LARGEST)) + SHIFT)
    rows = vectors.where(good).select(F.struct(*keep).alias("row"), x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    best = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size("x") == (best["size"] if best else 0))


def matrices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches with their vectors as rows of a matrix of 64-bit integers."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch, flat.reshape(batch.num_rows, -1)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of the entries; one row of each dimension comes to the driver."""
    each = rows.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s")).orderBy("i").collect()
    return (each[0]["n"], [int(r["s"]) for r in each]) if each else (0, [])


def spectrum(rows: DataFrame, size: int, around: np.ndarray) -> Spectrum:
    """Spectrum of all vectors less ``around`` by rank-one updates in tasks, combined in a tree of tasks."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(size)
        for _, x in matrices(batches, 0):
            # Repeated vectors are one update with a weight.
            distinct, times = np.unique(x, axis=0, return_counts=True)
            for v, k in zip(distinct - around, times.tolist()):
                own.add(v, k)
        if own.count:
            yield one_row(own)

    def one_row(s: Spectrum) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("count", "mean", "values", "vectors"), s.row()))], schema=pa.schema(
            [("count", pa.int64()), *[(c, pa.list_(pa.float64())) for c in ("mean", "values", "vectors")]]))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All spectra of one task become one."""
        own = Spectrum.empty(size)
        for batch in batches:
            for i in range(batch.num_rows):
                own.merge(Spectrum.of(*(batch.column(c)[i].as_py() for c in range(4))))
        if own.count:
            yield one_row(own)

    found = durable(rows.select("x").mapInArrow(update, SPECTRUM))
    left = found.count()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        found = durable(found.repartition(left).mapInArrow(combine, SPECTRUM))
        left = found.count()
    total = Spectrum.empty(size)
    for r in found.toLocalIterator():  # at most FAN_IN rows
        total.merge(Spectrum.of(*r))
    return total


def _summed(rows: DataFrame, work, size: int) -> np.ndarray:
    """Sum over tasks of the square matrix that ``work`` adds up from the task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, x in matrices(batches, 0):
            total += work(x)
        for i in range(size):
            yield pa.RecordBatch.from_arrays([pa.array([i] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(total[i])], ["i", "j", "v"])

    out = np.zeros((size, size))
    for r in rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def components(rows: DataFrame, n: int, total: list[int], wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The first eigenvalues and unit eigenvectors (columns) of the covariance, and its trace.

    The largest entry of an eigenvector is positive.
    """
    size = len(total)
    whole, rest = np.array([s // n for s in total]), np.array([s % n for s in total]) / n
    found = spectrum(rows, size, whole)
    basis = np.linalg.qr(found.vectors)[0]

    def products(x: np.ndarray) -> np.ndarray:
        y = ((x - whole) - rest) @ basis
        return y.T @ y

    # Rayleigh-Ritz: the covariance in the basis that the updates have found.
    ritz = _summed(rows, products, size) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    vectors = (basis @ turn)[:, ::-1][:, :wanted]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return np.maximum(values[::-1][:wanted], 0), vectors, float(np.trace(ritz))


def whiten(vectors: DataFrame, column: str = "embedding", keep: tuple[str, ...] = ("vec_id",), wanted: int = 8) -> DataFrame:
    """``row`` (struct of ``keep``), ``component, n, deviation, whitened, explained, identity_error`` per row and component.

    Entries become whole numbers x; n is the number of vectors, S the sums of their entries. ``deviation`` is the
    exact sum of (n x - S) ** 2, null if that exceeds 64 bits; ``whitened`` is the projection of x - S / n on the
    component over the root of its eigenvalue; ``explained`` is the eigenvalue's part of the trace.
    ``identity_error`` is the largest distance of the covariance of the whitened rows from the identity.

    Rows whose vector is null, empty or holds null or non-finite entries give nothing, nor do those of another
    length than most. Repeated rows count and are returned as often as they are there. Components without variance have whitened 0
    and are not in ``identity_error``; without any variance ``explained`` is 0. Entries beyond 2 ** 42 in size
    are held there. Other columns are ignored; an empty table gives no rows. The square of a vector's length
    is held by each task and the driver.
    """
    rows = durable(whole_numbers(vectors, column, list(keep)))
    n, total = sums(rows)
    schema = rows.select("row").schema.add("component", "integer").add("n", "long").add("deviation", "long").add(
        "whitened", "double").add("explained", "double").add("identity_error", "double")
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    values, directions, trace = components(rows, n, total, wanted)
    live = values > 1e-12 * max(trace, 1e-300)
    scale = np.where(live, 1 / np.sqrt(np.where(live, values, 1)), 0)
    whole, rest = np.array([s // n for s in total]), np.array([s % n for s in total]) / n
    centre = np.array(total, dtype=object)

    def project(x: np.ndarray) -> np.ndarray:
        return (((x - whole) - rest) @ directions) * scale

    def squares(x: np.ndarray) -> np.ndarray:
        y = project(x)
        return y.T @ y

    k = len(values)
    error = _summed(rows, squares, k) / n - np.diag(live.astype(float))
    identity_error = float(np.abs(error).max())
    explained = (values / trace if trace else np.zeros(k)).tolist()

    def deviations(x: np.ndarray) -> list:
        # Far from 64 bits in the usual case; else in Python's integers.
        most = max(abs(int(v)) for v in (x.min(), x.max())) * n + max(map(abs, total))
        if most * most * x.shape[1] < 1 << 63:
            y = n * x - np.array(total, np.int64)
            return (y * y).sum(1).tolist()
        sums_ = ((n * x.astype(object) - centre) ** 2).sum(1)
        return [int(s) if s < 1 << 63 else None for s in sums_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, 1):
            m = len(x)
            dev, each = deviations(x), np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n), pa.int64()), pa.array([dev[i] for i in each], pa.int64()),
                pa.array(project(x).ravel()), pa.array(explained * m, pa.float64()), pa.array([identity_error] * (m * k), pa.float64()),
            ], names=schema.names)

    return rows.select("row", "x").mapInArrow(run, schema)

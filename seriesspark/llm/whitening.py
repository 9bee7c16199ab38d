"""Whitening of embeddings by incremental eigendecomposition.

Entries become whole numbers ``x = floor(256 c)``; each distinct vector counts once in
the fit. A task holds the spectrum of its vectors' scatter matrix: every vector is a
centred rank-one update, solved through the secular equation

    1 + sum z_i^2 / (d_i - t) = 0

after deflation (parts of z that vanish, poles that meet), with eigenvectors from the
z that the found roots belong to, so they stay orthogonal. Spectra are combined a few
at a time by successive rank-one updates: one per eigenpair of the other and one for
the distance of the means. The last spectrum's basis is refined by Rayleigh-Ritz: a
pass over the fit list sums the projected products, whose eigenvectors turn the basis.
Sums and squares for means, trace and deviations are exact whole numbers.

What meets in a task or the driver is bounded by the square of the dimension. An update
costs the cube of the dimension.

Defined cases: rows whose vector is null, empty, shorter than the longest or holds null
or non-finite entries are dropped; repeated rows keep their own results and count once
in the fit; a component of eigenvalue 0 (up to rounding) has null ``whitened``, and
``explained`` is null if all vectors are equal; dimensions below ``components`` give
fewer components; ``deviation`` is null beyond 64 bits; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

FAN = 16             # spectra or matrices that are combined in one task
STEPS = 60           # of the secular iteration; some six are needed
EPS = np.finfo(float).eps


# --- rank-one updates --------------------------------------------------------

def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_j^2 / (d_j - t) for ascending, distinct d and nonzero z.

    Returns the roots and the matrix ``d_j - root_i`` (a row per root), each difference
    taken from the pole nearest to the root, so that it is accurate to its last bits.
    """
    k, w = len(d), z * z
    if k == 1:
        return d + w, -w[None, :]
    gap = np.append(np.diff(d), w.sum())
    last = np.arange(k) == k - 1
    middle = d + gap / 2
    at_middle = 1 + (w / (d - middle[:, None])).sum(axis=1)
    right = (at_middle < 0) & ~last
    origin = np.where(right, np.arange(k) + 1, np.arange(k))
    delta = d - d[origin][:, None]
    lo, hi = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(last, gap, gap / 2))
    lo, hi = np.where(last & (at_middle < 0), gap / 2, lo), np.where(last & (at_middle >= 0), gap / 2, hi)
    t = (lo + hi) / 2
    rows, left_pole, right_pole = np.arange(k), np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
    below = np.tri(k, dtype=bool)       # poles up to the root's own
    for _ in range(STEPS):
        diff = delta - t[:, None]
        term = w / diff
        g = 1 + term.sum(axis=1)
        lo, hi = np.where(g < 0, t, lo), np.where(g >= 0, t, hi)
        done = (np.abs(g) <= 4 * EPS * (1 + np.abs(term).sum(axis=1))) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if done.all():
            break
        slope = term / diff
        psi = np.where(below, slope, 0).sum(axis=1)
        phi = slope.sum(axis=1) - psi
        d1, d2 = diff[rows, left_pole], diff[rows, right_pole]
        with np.errstate(all="ignore"):
            a, b, c = (d1 + d2) * g - d1 * d2 * (psi + phi), d1 * d2 * g, g - d1 * psi - d2 * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            only = g - d1 * psi             # the last root has one pole beside it
            step = np.where(last, d1 + d1 * d1 * psi / only, step)
            new = t + step
        new = np.where(np.isfinite(new) & (new > lo) & (new < hi), new, (lo + hi) / 2)
        t = np.where(done, t, new)
    return d[origin] + t, delta - t[:, None]


def rank_one(d: np.ndarray, Q: np.ndarray, a: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``Q diag(d) Q' + weight a a'``."""
    a = a * np.sqrt(weight)
    size = np.sqrt(a @ a)
    if size == 0:
        return d, Q
    z = Q.T @ a
    if Q.shape[1] < Q.shape[0]:     # the part outside the space so far becomes a direction of eigenvalue 0
        out = a - Q @ z
        again = Q.T @ out
        z, out = z + again, out - Q @ again
        norm = np.sqrt(out @ out)
        if norm > 1e-10 * size:
            d, Q, z = np.append(0.0, d), np.column_stack([out / norm, Q]), np.append(norm, z)
    # deflation: poles that meet are turned so that one of them has no part in z
    tol = 8 * EPS * max(abs(d).max(initial=0.0), z @ z)
    live = np.abs(z) * size > tol
    if (np.diff(d[live]) <= tol).any():
        d, Q, z = d.copy(), Q.copy(), z.copy()
        before = -1
        for i in np.flatnonzero(live):
            if before >= 0:
                r = np.hypot(z[before], z[i])
                c, s = z[i] / r, z[before] / r
                if (d[i] - d[before]) * abs(c * s) <= tol:
                    z[before], z[i] = 0.0, r
                    low, high = d[before], d[i]
                    d[before], d[i] = low * c * c + high * s * s, low * s * s + high * c * c
                    Q[:, before], Q[:, i] = c * Q[:, before] - s * Q[:, i], s * Q[:, before] + c * Q[:, i]
                    live[before] = False
            before = i
    k = np.flatnonzero(live)
    if not len(k):
        return d, Q
    order = k[np.argsort(d[k], kind="stable")]
    poles, part = d[order], z[order]
    if (np.diff(poles) <= 0).any():     # turned poles may tie by a rounding: part them
        poles = np.maximum.accumulate(poles + np.arange(len(poles)) * tol / len(poles))
    roots, diff = secular_roots(poles, part)
    apart = poles[None, :] - poles[:, None]
    np.fill_diagonal(apart, 1.0)
    part = np.sqrt(np.abs(np.prod(-diff.T / apart, axis=1))) * np.where(part < 0, -1.0, 1.0)
    U = (part / diff).T
    U /= np.sqrt((U * U).sum(axis=0))
    new_d, new_Q = np.concatenate([d[~live], roots]), np.column_stack([Q[:, ~live], Q[:, order] @ U])
    up = np.argsort(new_d, kind="stable")
    return new_d[up], new_Q[:, up]


class Spectrum:
    """Count, mean and scatter of vectors, the scatter as eigenvalues and eigenvectors; exact sums beside them."""

    def __init__(self, dim: int):
        self.n, self.mean, self.d, self.Q = 0, np.zeros(dim), np.zeros(0), np.zeros((dim, 0))
        self.sums, self.squares = [0] * dim, 0

    def add(self, X: np.ndarray) -> None:
        for x in X.astype(float):
            a = x - self.mean
            if self.n:
                self.d, self.Q = rank_one(self.d, self.Q, a, self.n / (self.n + 1))
            self.n += 1
            self.mean = self.mean + a / self.n
        if len(X):
            big = float(np.abs(X.astype(float)).max()) ** 2 * X.size >= 2.0 ** 62
            whole = X.astype(object) if big else X
            self.sums = [s + int(v) for s, v in zip(self.sums, whole.sum(axis=0))]
            self.squares += int((whole * whole).sum())

    def join(self, other: Spectrum) -> None:
        if other.n and self.n:
            for value, vector in zip(other.d, other.Q.T):
                if value > 0:
                    self.d, self.Q = rank_one(self.d, self.Q, vector, value)
            self.d, self.Q = rank_one(self.d, self.Q, other.mean - self.mean, self.n * other.n / (self.n + other.n))
            self.mean = self.mean + (other.mean - self.mean) * (other.n / (self.n + other.n))
        elif other.n:
            self.mean, self.d, self.Q = other.mean, other.d, other.Q
        self.n += other.n
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self.squares += other.squares

    def row(self) -> dict:
        return {"n": self.n, "mean": self.mean.tobytes(), "d": self.d.tobytes(), "q": np.ascontiguousarray(self.Q).tobytes(),
                "sums": [str(s) for s in self.sums], "squares": str(self.squares)}

    @classmethod
    def of_row(cls, row: dict) -> Spectrum:
        out = cls(len(row["sums"]))
        out.n, out.mean, out.d = row["n"], np.frombuffer(row["mean"]), np.frombuffer(row["d"])
        out.Q = np.frombuffer(row["q"]).reshape(len(out.mean), len(out.d))
        out.sums, out.squares = [int(s) for s in row["sums"]], int(row["squares"])
        return out


# --- Spark jobs --------------------------------------------------------------

def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def folded(parts: DataFrame, merge: Callable[[list[dict]], dict], name: str) -> dict | None:
    """One row from the rows of ``part`` and further columns: FAN rows at a time, level by level."""
    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        return pa.Table.from_pylist([merge(rows) | {"part": rows[0]["part"] // FAN}], schema=table.schema)

    parts = materialize(parts, name)
    most = parts.agg(F.max("part")).first()[0]
    while most:
        parts = materialize(parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(fold, parts.schema), name)
        most //= FAN
    row = parts.first()
    return row and row.asDict()


def vectors(rows: DataFrame, *, key: str, vector: str) -> DataFrame:
    """``vec_id, x`` of the rows whose vector is whole."""
    v = F.col(vector)
    whole = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = rows.select(F.col(key).alias("vec_id"), F.when(whole, F.transform(v, lambda c: F.floor(c.cast("double") * 256).cast("long"))).alias("x"))
    good = good.where(F.col("x").isNotNull() & (F.size("x") > 0))
    longest = good.agg(F.max(F.size("x"))).first()[0] or 0
    return good.where(F.size("x") == longest)


def spectrum(fit: DataFrame) -> Spectrum | None:
    """The spectrum of all ``x`` of the fit list."""
    def updates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        own = None
        for batch in batches:
            if len(batch):
                X = matrix(batch.column("x"))
                own = own or Spectrum(X.shape[1])
                own.add(X)
        if own:
            yield pa.RecordBatch.from_pylist([own.row() | {"part": TaskContext.get().partitionId()}], schema=kinds)

    def join(rows: list[dict]) -> dict:
        out = Spectrum.of_row(rows[0])
        for r in rows[1:]:
            out.join(Spectrum.of_row(r))
        return out.row()

    kinds = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.binary()), ("d", pa.binary()), ("q", pa.binary()),
                       ("sums", pa.list_(pa.string())), ("squares", pa.string())])
    row = folded(fit.mapInArrow(updates, "part bigint, n bigint, mean binary, d binary, q binary, sums array<string>, squares string"), join, "spectra")
    return row and Spectrum.of_row(row)


def centred(X: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S`` as doubles, exact before rounding."""
    if n * float(np.abs(X.astype(float)).max(initial=0.0)) < 2.0 ** 61 and max(map(abs, sums)) < 2 ** 61:
        return (n * X - np.array(sums, np.int64)).astype(float)
    return (n * X.astype(object) - np.array(sums, object)).astype(float)


def products(fit: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """The sum of y y' over the fit list, y the centred vector in the basis."""
    size = basis.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros((size, size))
        for batch in batches:
            X = matrix(batch.column("x")) if len(batch) else np.zeros((0, len(sums)), np.int64)
            for a in range(0, len(X), 4096):
                Y = (centred(X[a:a + 4096], n, sums) / n) @ basis
                total += Y.T @ Y
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "total": total.tobytes()}])

    def join(rows: list[dict]) -> dict:
        return {"total": sum(np.frombuffer(r["total"]) for r in rows).tobytes()}

    row = folded(fit.mapInArrow(add, "part bigint, total binary"), join, "products")
    return np.frombuffer(row["total"]).reshape(size, size)


def deviations(X: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2 per row, null beyond 64 bits."""
    far = n * float(np.abs(X.astype(float)).max(initial=0.0)) + max(map(abs, sums))
    if far * far * X.shape[1] < 2.0 ** 62:
        return ((n * X - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * X.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 2 ** 63 else None for v in exact]


def whiten(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per whole vector and component."""
    spark = rows.sparkSession
    all_rows = vectors(rows, key=key, vector=vector)
    # distinct first, so that a frequent vector is one row before rows are dealt evenly
    fit = materialize(all_rows.select("x").distinct().repartition(partitions(spark), "x"), "fit")
    found = spectrum(fit)
    schema = f"{key} {dict(rows.dtypes)[key]}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if found is None:
        return spark.createDataFrame([], schema)
    n, sums, dim = found.n, found.sums, len(found.sums)
    trace = (n * found.squares - sum(s * s for s in sums)) / n ** 2
    # Rayleigh-Ritz in the whole space: the found directions, completed to a basis
    basis = np.linalg.qr(np.column_stack([found.Q[:, ::-1], np.eye(dim)]))[0]
    value, turn = np.linalg.eigh(products(fit, n, sums, basis) / n)
    k = min(components, dim)
    value, axes = value[::-1][:k], (basis @ turn[:, ::-1])[:, :k]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    real = value > max(value[0], 0.0) * dim * EPS if value[0] > 0 else np.zeros(k, bool)
    scale = np.where(real, 1 / np.sqrt(np.where(real, value, 1.0)), 0.0)
    error = float(np.abs(products(fit, n, sums, axes[:, real] * scale[real]) / n - np.eye(int(real.sum()))).max()) if real.any() else None
    explained = [float(v) / trace if trace else None for v in value]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                X = matrix(part.column("x"))
                Y = (centred(X, n, sums) / n) @ axes * scale
                m, off = len(X), np.repeat(np.arange(len(X)), k)
                tile = lambda v, kind: pa.array(list(v) * m, kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(off)), tile(range(1, k + 1), pa.int32()), pa.array(np.full(m * k, n)),
                     pa.array(deviations(X, n, sums), pa.int64()).take(pa.array(off)), pa.array(Y.reshape(-1), mask=np.tile(~real, m)),
                     tile(explained, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return all_rows.mapInArrow(project, schema)

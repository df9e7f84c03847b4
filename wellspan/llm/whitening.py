"""Whitening of embeddings by incremental eigendecomposition.

1. *Rank-one updates.* Every partition keeps count, mean and the eigensystem of its scatter matrix. A vector
   changes the scatter by ``n / (n + 1)`` times the square of its distance from the mean so far, a rank-one
   update: with ``z`` the distance in the eigenbasis, the new eigenvalues are the roots of the secular equation
   ``1 + rho * sum(z_j**2 / (d_j - x)) = 0``, one between each two old ones. Eigenvalues that are equal, or have
   no part in ``z``, are deflated. A vector with a part outside the basis widens it by one.
2. *Combination.* Two spectra become one by an update for each eigenpair of the second and one for the distance
   of the means. Spectra climb a tree, ``FAN_IN`` to a task, so that no task holds more than these.
3. *Rayleigh-Ritz.* The basis is completed to all dimensions; the covariance, centred on the exact mean, is
   computed in that basis where the rows are, the matrices climb the same tree, and the eigenpairs of their sum
   turn the basis into the components. What rounding did in steps 1 and 2 doesn't matter any more.

Entries are read as whole numbers ``floor(scale * c) + shift``, so that sums are exact. Rows whose vector is
null or has a null or non-finite entry are dropped. So are vectors of another length than the commonest (of
equally common lengths the longest) and those with an entry beyond 2**40, whose sums would not be exact.
Vectors without entries have no components. A component without variance (fewer different vectors than
dimensions) has NULL for its whitened value and is left out of ``identity_error``. ``deviation`` is NULL where it
exceeds a long. An empty table gives no rows; repeated rows count as often as they occur; only the two columns
named are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from wellspan.llm.common import map_batches, table
from wellspan.session import materialize

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 40
FAN_IN = 8
EPS = np.finfo(float).eps
ROUNDS = 60
ENOUGH = 1e-13  # of the terms of the secular equation; their sum at a root is known no better than to some roundings


def _spread_basis(d: np.ndarray, z: np.ndarray, u: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rotate ``u`` inside the groups of equal eigenvalues, so that one of a group has all of its ``z``."""
    close = np.flatnonzero(np.diff(d) <= least)
    if not len(close):
        return z, u
    z, u = z.copy(), u.copy()
    for part in np.split(close, np.flatnonzero(np.diff(close) > 1) + 1):
        a, b = part[0], part[-1] + 2
        norm = np.linalg.norm(z[a:b])
        if norm == 0:
            continue
        # the reflection that maps z[a:b] to its norm in the last place
        v = z[a:b].copy()
        sign = 1.0 if v[-1] >= 0 else -1.0
        v[-1] += sign * norm
        v /= np.linalg.norm(v)
        u[:, a:b] -= 2 * np.outer(u[:, a:b] @ v, v)
        z[a:b] = 0.0
        z[b - 1] = -sign * norm
    return z, u


def _secular_roots(d: np.ndarray, zz: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(zz / (d - x))`` for ascending ``d``, each as (number of the nearest pole, distance from it).

    Around root i the poles below and above are each replaced by the one nearest the root with the right value and
    slope (Bunch, Nielsen and Sorensen); the root of that is the next guess, or the middle if it lies outside.
    """
    m = len(d)
    nxt = np.append(d[1:], d[-1] + rho * zz.sum())
    gap = nxt - d
    middle = 1 + rho * (zz / (d[None, :] - (d + gap / 2)[:, None])).sum(axis=1)
    # the last root has no pole above it
    upper = (middle < 0) & (np.arange(m) < m - 1)
    pole = np.where(upper, np.arange(m) + 1, np.arange(m))
    far = d[None, :] - d[pole][:, None]  # poles as seen from the nearest one
    low = np.where(upper, -gap / 2, np.where(middle < 0, gap / 2, 0.0))
    high = np.where(upper, 0.0, np.where(middle < 0, gap, gap / 2))
    below = np.tri(m)
    left = far[np.arange(m), np.arange(m)]
    right = np.append(far[np.arange(m - 1), np.arange(1, m)], 0.0)
    x = (low + high) / 2
    going = np.arange(m)
    for _ in range(ROUNDS):
        if len(going) == m:
            t, f, lower = x, far, below
        else:
            t, f, lower = x[going], far[going], below[going]
        diff = f - t[:, None]
        terms = zz / diff
        np.divide(terms, diff, out=diff)  # slopes
        psi, phi = np.einsum("ij,ij->i", terms, lower), terms.sum(axis=1)
        ps, ph = np.einsum("ij,ij->i", diff, lower), diff.sum(axis=1)
        psi, phi, ps, ph = rho * psi, rho * (phi - psi), rho * ps, rho * (ph - ps)
        value = 1 + psi + phi
        size = 1 + np.abs(psi) + np.abs(phi)
        low[going] = np.where(value < 0, t, low[going])
        high[going] = np.where(value < 0, high[going], t)
        dl, dr = left[going] - t, right[going] - t
        # psi ~ a + s / (left - x), phi ~ b + r / (right - x), last root: phi = 0
        s, r = ps * dl * dl, ph * dr * dr
        c = 1 + (psi - ps * dl) + (phi - ph * dr)
        # c + s / (left - x) + r / (right - x) = 0, x = t + e
        qa, qb, qc = c, -(c * (dl + dr) + s + r), c * dl * dr + s * dr + r * dl
        last = going == m - 1
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(qb * qb - 4 * qa * qc, 0))
            e = np.where(qb <= 0, 2 * qc / (-qb + root), (-qb - root) / (2 * qa))
            other = np.where(qb <= 0, (-qb + root) / (2 * qa), 2 * qc / (-qb - root))
            e = np.where(last, dl + s / c, e)
            new = t + e
            new = np.where((new > low[going]) & (new < high[going]), new, t + other)
        a, b = low[going], high[going]
        new = np.where((new > a) & (new < b), new, (a + b) / 2)
        done = (np.abs(value) <= ENOUGH * size) | (b - a <= 2 * EPS * np.maximum(np.abs(a), np.abs(b)))
        x[going] = np.where(done, t, new)
        going = going[~done]
        if not len(going):
            break
    return pole, x


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigensystem (ascending) of ``u @ diag(d) @ u.T + rho * outer(v, v)``; the columns of ``u`` may be fewer than its rows."""
    if rho <= 0:
        return d, u
    z = u.T @ v
    rest = v - u @ z
    if u.shape[1] < u.shape[0]:
        again = u.T @ rest  # once more, for columns at right angles
        z, rest = z + again, rest - u @ again
        norm = np.linalg.norm(rest)
        if norm > 64 * EPS * np.linalg.norm(v):
            u, d, z = np.column_stack([rest / norm, u]), np.append(0.0, d), np.append(norm, z)
    size = rho * float(z @ z)
    if size == 0 or not len(d):
        return d, u
    scale = max(float(d[-1]), size)
    z, u = _spread_basis(d, z, u, 8 * EPS * scale)
    moving = rho * np.abs(z) * np.linalg.norm(z) > 8 * EPS * scale
    if not moving.any():
        return d, u
    dm, zm = d[moving], z[moving]
    pole, x = _secular_roots(dm, zm * zm, rho)
    # poles less roots, without cancellation; then z for which these roots are exact (Gu and Eisenstat)
    diff = (dm[:, None] - dm[pole][None, :]) - x[None, :]
    m = len(dm)
    ratio = -diff  # root i less pole j
    gaps = dm[None, :] - dm[:, None]
    gaps[np.arange(m), np.arange(m)] = 1.0
    with np.errstate(all="ignore"):
        ratio /= gaps  # gaps of a pole with itself count as one
        exact = np.sqrt(np.maximum(np.prod(ratio, axis=1), 0)) * np.where(zm < 0, -1, 1)
        w = exact[:, None] / diff
    bad = ~np.isfinite(w).all(axis=0)  # a root on its pole
    w[:, bad] = 0.0
    w[pole[bad], bad] = 1.0
    w /= np.linalg.norm(w, axis=0)
    out = d.copy()
    out[moving] = dm[pole] + x
    u = u.copy()
    u[:, moving] = u[:, moving] @ w
    order = np.argsort(out, kind="stable")
    return np.maximum(out[order], 0.0), u[:, order]


class Spectrum:
    """Count, mean and eigensystem of the scatter of some vectors."""

    def __init__(self, n: int, mean: np.ndarray, d: np.ndarray | None = None, u: np.ndarray | None = None):
        self.n, self.mean = n, mean
        self.d = np.empty(0) if d is None else d
        self.u = np.empty((len(mean), 0)) if u is None else u

    def add(self, vector: np.ndarray) -> None:
        away = vector - self.mean
        self.d, self.u = rank_one(self.d, self.u, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        if not self.n:
            self.n, self.mean, self.d, self.u = other.n, other.mean, other.d, other.u
            return
        if not other.n:
            return
        for value, vector in zip(other.d, other.u.T):
            self.d, self.u = rank_one(self.d, self.u, vector, float(value))
        away, n = other.mean - self.mean, self.n + other.n
        self.d, self.u = rank_one(self.d, self.u, away, self.n * other.n / n)
        self.mean, self.n = self.mean + away * (other.n / n), n

    def basis(self) -> np.ndarray:
        """An orthonormal basis of all dimensions that begins with the eigenvectors, the largest first."""
        k = len(self.mean)
        return np.linalg.qr(np.column_stack([self.u[:, ::-1], np.eye(k)]))[0][:, :k]


def whole(vector: str, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """Entries as whole numbers; NULL if the vector has none that all are finite and within bounds."""
    def fine(c: Column) -> Column:
        c = c.cast("double")
        return F.coalesce(F.abs(c) <= F.lit(float(LARGEST // scale)), F.lit(False)) & ~F.isnan(c)

    return F.when(F.col(vector).isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False)), F.transform(
        vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift)))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(batch.num_rows, -1)


def _rows(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    values = np.ascontiguousarray(values)
    size = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * size, pa.int32()), pa.array(values.ravel(), kind))


def _climb(parts: DataFrame, combine) -> DataFrame:
    """One row of ``parts`` (``part``, ``n``, ``a``, ``b``, ``c``), combined ``FAN_IN`` at a time in tasks; none if there is none."""
    parts = materialize(parts, "spectra")
    left = parts.agg(F.max("part")).first()[0]
    schema = "part bigint, n bigint, a array<double>, b array<double>, c array<double>"

    def merged(found: pa.Table) -> pa.Table:
        rows = sorted(found.to_pylist(), key=lambda r: r["part"])
        n, a, b, c = combine([(r["n"], *(np.array(r[k], float) for k in "abc")) for r in rows])
        return pa.table({"part": [rows[0]["part"] // FAN_IN], "n": [n], **{k: pa.array([list(v)], pa.list_(pa.float64())) for k, v in zip("abc", (a, b, c))}},
                        pa.schema([("part", pa.int64()), ("n", pa.int64()), *((k, pa.list_(pa.float64())) for k in "abc")]))

    while left:
        up = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("_up")).applyInArrow(merged, schema)
        parts = materialize(up, "spectra")
        left //= FAN_IN
    return parts


def _merged_spectra(rows: list[tuple]) -> tuple:
    total = None
    for n, mean, d, u in rows:
        one = Spectrum(n, mean, d, u.reshape(len(mean), -1))
        if total is None:
            total = one
        else:
            total.merge(one)
    return total.n, total.mean, total.d, total.u.ravel()


def _added(rows: list[tuple]) -> tuple:
    return (sum(r[0] for r in rows), *(sum(r[k] for r in rows) for k in (1, 2, 3)))


PART = "part bigint, n bigint, a array<double>, b array<double>, c array<double>"


def _part(n: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    kind = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), *(pa.array([list(v)], kind) for v in (a, b, c))],
        ["part", "n", "a", "b", "c"])


def spectra(vectors: DataFrame) -> DataFrame:
    """The spectrum of each partition of ``vectors`` (``x``): count, mean, eigenvalues, eigenvectors."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                for row in _matrix(batch, "x").astype(float):
                    if total is None:
                        total = Spectrum(1, row)
                    else:
                        total.add(row)
        if total is not None:
            yield _part(total.n, total.mean, total.d, total.u.ravel())

    return vectors.select("x").mapInArrow(run, PART)


def moments(vectors: DataFrame, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    """For each partition the sums and products of its vectors, less ``mean``, in ``basis``."""

    def run(batches):
        n, s, g = 0, np.zeros(basis.shape[1]), np.zeros((basis.shape[1],) * 2)
        for batch in batches:
            if batch.num_rows:
                y = (_matrix(batch, "x") - mean) @ basis
                n, s, g = n + len(y), s + y.sum(axis=0), g + y.T @ y
        if n:
            yield _part(n, s, g.ravel(), np.zeros(0))

    return vectors.select("x").mapInArrow(run, PART)


class Whitening:
    """Fitted components: ``n``, exact ``sums``, ``components`` (columns, by falling ``values``), ``trace``, ``identity_error``."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.components, self.values, self.trace = n, sums, components, values, trace
        self.mean = np.array([s / n for s in sums])
        self.real = values > len(sums) * EPS * max(trace, 1e-300)
        self.identity_error = 0.0

    def matrix(self) -> np.ndarray:
        return self.components / np.sqrt(np.where(self.real, self.values, 1.0))


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """Whitening of all rows of ``vectors`` (``x``, whole numbers of one length); None without rows or dimensions.

    The driver sees one spectrum, one matrix and one sum for each dimension.
    """
    # sums as text of decimals: exact beyond a long
    totals = vectors.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(
        F.sum(F.col("v").cast("decimal(20,0)")).cast("string").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    if not totals:
        return None
    totals.sort(key=lambda r: r["dim"])
    n, sums = totals[0]["n"], [int(r["s"]) for r in totals]
    k = len(sums)
    top = _climb(spectra(vectors), _merged_spectra).first()
    basis = Spectrum(top["n"], np.array(top["a"]), np.array(top["b"]), np.array(top["c"]).reshape(k, -1)).basis()
    mean = np.array([s / n for s in sums])
    found = _climb(moments(vectors, mean, basis), _added).first()
    ritz = np.array(found["b"]).reshape(k, k) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, turn = np.maximum(values[::-1], 0.0), turn[:, ::-1]
    out = Whitening(n, sums, (basis @ turn)[:, :components], values[:components], float(np.trace(ritz)))
    if out.real.any():
        # the covariance of the values as they are handed out
        check = _climb(moments(vectors, out.mean, out.matrix()[:, out.real]), _added).first()
        s = np.array(check["a"]) / n
        c = np.array(check["b"]).reshape(len(s), len(s)) / n - np.outer(s, s)
        out.identity_error = float(np.abs(c - np.eye(len(s))).max())
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - S)**2, None beyond a long."""
    small = n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62 and max(map(abs, sums)) < 1 << 62
    if small:
        away = n * x - np.array(sums, np.int64)
        if int(np.abs(away).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (away * away).sum(axis=1).tolist()
    out = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def apply(vectors: DataFrame, model: Whitening, key: str) -> DataFrame:
    """``key``, ``deviation`` and ``whitened`` (array, one value for each component) of each row."""
    matrix, mean, n, sums, real = model.matrix(), model.mean, model.n, model.sums, model.real

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _matrix(batch, "x")
            y = ((x - mean) @ matrix).astype(object)
            y[:, ~real] = None
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_deviations(x, n, sums), pa.int64()), pa.array(y.tolist(), pa.list_(pa.float64()))],
                ["key", "deviation", "whitened"])

        return step

    kind = vectors.schema[key].dataType.simpleString()
    return map_batches(vectors.select(key, "x"), start, f"key {kind}, deviation bigint, whitened array<double>").withColumnRenamed("key", key)


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8,
             scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row for each vector that remains and each component (from 1): see the module's text for the columns."""
    vectors = df.select(F.col(key).alias("key"), whole(vector, scale, shift).alias("x")).where(F.col("x").isNotNull())
    lengths = vectors.groupBy(F.size("x").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("k")).first()
    vectors = vectors.where(F.size("x") == F.lit(common["k"] if common else 0))
    model = fit(vectors, components) if common and common["k"] else None
    if model is None:
        kinds = {"component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
        return vectors.where(F.lit(False)).select(F.col("key").alias(key), *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])
    share = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    explained = F.array(*[F.lit(v).cast("double") for v in share])
    rows = apply(vectors, model, "key").select(
        F.col("key").alias(key), F.lit(model.n).cast("bigint").alias("n"), "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return rows.select(key, (F.col("_at") + 1).alias("component"), "n", "deviation", "whitened",
                       F.get(explained, F.col("_at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")

"""Whitening of embeddings by an incremental eigendecomposition.

1. Each task keeps count, mean and eigendecomposition of the scatter of the rows it has read. A block of rows is centred at its own mean
   and, if it has more rows than dimensions, reduced to a triangular factor of the same scatter; each of its rows is then a rank-one
   update of the decomposition, and one more accounts for the distance of the means (`block=1`: one update per vector).
2. A rank-one update solves the secular equation of all eigenvalues at once, after deflation: small or equal entries leave it.
   The update vector is recomputed from the roots found, so eigenvectors stay orthogonal to working precision.
3. Spectra of tasks meet in groups of `FAN`, level by level: the eigenpairs of one are rank-one updates of the other.
4. A Rayleigh-Ritz step refines the result: one pass adds up the exactly centred covariance in the basis found, and its eigenvectors turn the basis.
5. A second pass measures the covariance of the whitened vectors; a third returns them.

Vectors become whole numbers floor(64 * c) + 1000000, so sums, means and deviations are exact. A task holds a decomposition (d x d) and a block;
what reaches the driver is one decomposition. No shuffle but of decompositions.

Defined cases: rows whose vector is null or empty or holds a null or non-finite entry, or one beyond 2^25, are left out, as are vectors of another than the
most frequent dimension (ties: the larger); a null id is an id like any other; repeated rows count and are returned each; components without
variance (equal vectors; fewer vectors than dimensions) are not returned; other columns are not read; an empty table gives no
rows. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlens.session import materialize

SCALE, SHIFT = 64, 1_000_000
#: Entries of larger size do not take part: their sums could leave a long.
LARGEST = float(1 << 25)
#: Rows reduced at once; spectra that meet in one group.
BLOCK, FAN = 1 << 14, 16
COMPONENTS = 32
EPS = np.finfo(np.float64).eps


# ---------------------------------------------------------------- rank-one updates

def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z^2 / (d - x)) for strictly ascending d, as (nearest pole, distance from it), one above each d.

    All roots at once: rational steps with a pole on either side, kept inside a shrinking bracket by bisection.
    """
    n, w = len(d), z * z
    right = np.append(d[1:], d[-1] + w.sum())
    gap = right - d
    at_middle = 1 + (w / (d[None, :] - d[:, None] - gap[:, None] / 2)).sum(axis=1)
    pole = np.where((at_middle > 0) | (np.arange(n) == n - 1), np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    delta = d[None, :] - d[pole][:, None]
    first = pole == np.arange(n)
    low, high = np.where(first, 0.0, -gap / 2), np.where(first, np.where(at_middle > 0, gap / 2, gap), 0.0)
    low = np.where(first & (at_middle <= 0), gap / 2, low)
    low_pole, up = np.tril(np.ones((n, n), bool)), np.arange(n) == n - 1
    own_left = delta[np.arange(n), np.arange(n)]  # pole to the left, from the origin
    own_right = np.append(delta[np.arange(n - 1), np.arange(1, n)], np.inf)
    x = (low + high) / 2
    for _ in range(100):
        t = delta - x[:, None]
        t[t == 0] = np.finfo(np.float64).tiny
        part = w / t
        f = 1 + part.sum(axis=1)
        slope = part / t
        psi, phi = np.where(low_pole, slope, 0).sum(axis=1), np.where(low_pole, 0, slope).sum(axis=1)
        low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
        done = (np.abs(f) <= EPS * (1 + np.abs(part).sum(axis=1))) | (high - low <= 2 * EPS * np.minimum(np.abs(low), np.abs(high)))
        if done.all():
            break
        dl, dr = own_left - x, np.where(up, 1.0, own_right - x)
        with np.errstate(all="ignore"):
            a, b, c = (dl + dr) * f - dl * dr * (psi + phi), dl * dr * f, f - dl * psi - dr * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # The last root has a pole on its left only.
            last = f - dl * psi
            step = np.where(up, np.where(last > 0, dl + psi * dl * dl / last, np.nan), step)
        new = x + step
        outside = ~np.isfinite(new) | (new <= low) | (new >= high)
        x = np.where(done, x, np.where(outside, (low + high) / 2, new))
    return pole, x


def update(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigendecomposition (ascending values, columns) of Q diag(values) Q' + v v'."""
    z = vectors.T @ v
    size = float(np.sqrt(z @ z))
    if not size:
        return values, vectors
    d, q = values.copy(), vectors.copy()
    tol = 8 * EPS * max(float(np.abs(d).max()), size * size)
    # Deflation: entries that change nothing leave; of eigenvalues that are equal, a rotation moves all of z into the last.
    keep: list[int] = []
    for k in np.flatnonzero(np.abs(z) * size > tol).tolist():
        if keep:
            j = keep[-1]
            r = float(np.hypot(z[j], z[k]))
            c, s = z[k] / r, z[j] / r
            if abs((d[k] - d[j]) * c * s) <= tol:
                q[:, j], q[:, k] = c * q[:, j] - s * q[:, k], s * q[:, j] + c * q[:, k]
                d[j], d[k] = c * c * d[j] + s * s * d[k], s * s * d[j] + c * c * d[k]
                z[j], z[k] = 0.0, r
                keep.pop()
        keep.append(k)
    dk, zk = d[keep], z[keep]
    if not keep:
        return values, vectors
    if len(keep) == 1:
        d[keep[0]] += zk[0] ** 2
    else:
        pole, x = secular(dk, zk)
        # moved[i, j] = root j - pole i, without cancellation
        moved = (dk[pole][None, :] - dk[:, None]) + x[None, :]
        between = dk[None, :] - dk[:, None]
        np.fill_diagonal(between, 1.0)
        exact = np.sqrt(np.abs((moved / between).prod(axis=1))) * np.sign(zk)
        u = exact[:, None] / -moved
        u /= np.sqrt((u * u).sum(axis=0))
        q[:, keep] = q[:, keep] @ u
        d[keep] = dk[pole] + x
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


# ---------------------------------------------------------------- spectra

@dataclass
class Spectrum:
    """Count, exact sums and the eigendecomposition of the scatter about the mean."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d, np.int64), np.zeros(d), np.eye(d))

    def add(self, other_n: int, other_sums: np.ndarray, rows: np.ndarray) -> None:
        """Takes in rows with that count and sums, of which `rows` are a factor of the centred scatter."""
        n, m = self.n, other_n
        if n and m:
            # m * S - n * T is exact while it fits; means differ by it over n * m
            apart = (float(m) * self.sums - float(n) * other_sums) / (float(n) * m) if n * m >= 1 << 20 else (m * self.sums - n * other_sums) / (n * m)
            rows = np.vstack([rows, apart * np.sqrt(n * m / (n + m))])
        for v in rows:
            self.values, self.vectors = update(self.values, self.vectors, v)
        self.n, self.sums = n + m, self.sums + other_sums

    def merge(self, other: Spectrum) -> None:
        pairs = other.values > 0
        self.add(other.n, other.sums, (other.vectors[:, pairs] * np.sqrt(other.values[pairs])).T)

    def block(self, x: np.ndarray) -> None:
        """Takes in rows of whole numbers."""
        n, sums = len(x), x.sum(axis=0)
        centred = (n * (x - x[0]) - (sums - n * x[0])) / n
        self.add(n, sums, np.linalg.qr(centred, mode="r") if n > x.shape[1] else centred)

    def table(self, group: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "g": pa.array([group], pa.int64()), "n": pa.array([self.n], pa.int64()), "sums": pa.array([self.sums], pa.list_(pa.int64())),
            "vals": pa.array([self.values], pa.list_(pa.float64())), "vecs": pa.array([self.vectors.ravel()], pa.list_(pa.float64()))})

    @classmethod
    def rows(cls, table: pa.Table) -> Iterator[Spectrum]:
        for r in table.select(["n", "sums", "vals", "vecs"]).to_pylist():
            d = len(r["sums"])
            yield cls(r["n"], np.array(r["sums"], np.int64), np.array(r["vals"]), np.array(r["vecs"]).reshape(d, d))


SPECTRUM = "g long, n long, sums array<long>, vals array<double>, vecs array<double>"


def _levels(parts: DataFrame, schema: str, combine: Callable[[pa.Table], pa.RecordBatch], purpose: str) -> pa.Table:
    """Combines rows with a group number `g` in groups of FAN until few enough are left for the driver to combine the last."""
    parts = materialize(parts, purpose)
    while (n := parts.count()) > FAN:
        groups = max(1, -(-n // FAN))
        dealt = parts.withColumn("g", F.pmod(F.xxhash64("g"), F.lit(groups)))
        parts = materialize(dealt.groupBy("g").applyInArrow(lambda t: pa.Table.from_batches([combine(t)]), schema), purpose)
    return parts.toArrow()


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the whole numbers, of all rows that take part."""
    whole = F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = v.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)))
    top = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return fine.where(F.size("v") == (top["d"] if top else 0)).select("vec_id", whole.alias("x"))


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for k in range(0, batch.num_rows, size):
        part = batch.slice(k, size)
        yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def fitted(rows: DataFrame, block: int = BLOCK) -> Spectrum | None:
    """The spectrum of all rows; None if there are none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for _, x in _blocks(batch, block):
                own = own or Spectrum.empty(x.shape[1])
                own.block(x)
        if own:
            yield own.table(int(own.sums[0]) ^ own.n)

    def together(table: pa.Table) -> pa.RecordBatch:
        out = None
        for part in sorted(Spectrum.rows(table), key=lambda s: (s.n, s.sums.tolist())):
            if out:
                out.merge(part)
            else:
                out = part
        return out.table(int(out.sums[0]) ^ out.n)

    left = _levels(rows.select("x").mapInArrow(run, SPECTRUM), SPECTRUM, together, "whiten-spectra")
    return next(Spectrum.rows(pa.Table.from_batches([together(left)]))) if left.num_rows else None


def _scatter(rows: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Covariance of the exactly centred rows in `basis` (columns), summed over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((basis.shape[1],) * 2), 0
        for batch in batches:
            for _, x in _blocks(batch, block):
                y = centred(x, n, sums) @ basis
                total += y.T @ y
                seen += len(x)
        if seen:
            yield pa.RecordBatch.from_pydict({"g": pa.array([seen + int(total.trace()) % (1 << 40)], pa.int64()), "sums": pa.array([total.ravel()], pa.list_(pa.float64()))})

    def together(table: pa.Table) -> pa.RecordBatch:
        parts = sorted(table.column("sums").to_pylist())
        return pa.RecordBatch.from_pydict({"g": pa.array([len(parts)], pa.int64()), "sums": pa.array([np.sum(parts, axis=0)], pa.list_(pa.float64()))})

    left = _levels(rows.select("x").mapInArrow(run, "g long, sums array<double>"), "g long, sums array<double>", together, "whiten-sums")
    return np.array(together(left).column("sums")[0].as_py()).reshape((basis.shape[1],) * 2) / n


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n; the numerator is a whole number."""
    return _above(x, n, sums) / n


def _above(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: about the rounded mean first, so that products stay small."""
    mean = sums // n
    rest = sums - n * mean
    return n * (x - mean) - rest


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums over dimensions of (n * x - sums)^2, exact."""
    above = _above(x, n, sums)
    if np.abs(above.astype(np.float64)).max(initial=0) ** 2 * x.shape[1] < float(1 << 62):
        return (above * above).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in above.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


@dataclass
class Whitening:
    """n, exact sums, and by falling eigenvalue: values, unit eigenvectors (columns), the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.vectors / np.sqrt(self.values))


def fit(rows: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """Components with variance, at most `components`."""
    found = fitted(rows, block)
    if found is None:
        return None
    basis = found.vectors[:, ::-1]
    ritz, turn = np.linalg.eigh(_scatter(rows, found.n, found.sums, basis))
    values, vectors = ritz[::-1], basis @ turn[:, ::-1]
    kept = min(components, int((values > values[0] * 1e-12 * len(values)).sum()) if values[0] > 0 else 0)
    return Whitening(found.n, found.sums, values[:kept], vectors[:, :kept], float(values.sum()))


def whitened(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per row and component."""
    rows = prepared(vectors)
    model = fit(rows, components, block)
    schema = "vec_id long, deviation long, w array<double>"
    if model is None or not len(model.values):
        none = rows.select("vec_id", F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("w")).where("false")
        return _result(none, 0, [], 0.0)
    error = np.abs(_scatter(rows, model.n, model.sums, model.vectors / np.sqrt(model.values)) - np.eye(len(model.values))).max()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch, block):
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id"), pa.array(deviations(x, model.n, model.sums), pa.int64()),
                    pa.array(list(model.apply(x)), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    return _result(rows.mapInArrow(run, schema), model.n, (model.values / model.trace).tolist(), float(error))


def _result(rows: DataFrame, n: int, explained: list[float], error: float) -> DataFrame:
    shares = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))

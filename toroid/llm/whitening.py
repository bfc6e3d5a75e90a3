"""Whitening of embeddings by principal components; eigenvectors by a block Jacobi-Davidson method.

The covariance matrix is never formed. All that the solver asks of the data is its product with a block of vectors, which
is one pass: every task centres its rows, multiplies them with the block and with the result once more, and sends one
matrix of dimension x block. Those are added up by FAN tasks at most before the driver adds the rest, so what
reaches the driver depends on the dimension and the block, not on the number of rows.

An outer step takes the Ritz pairs of the search space (Rayleigh-Ritz), locks those whose residual has reached double
precision, and extends the space by corrections for the next ones. A correction t of the Ritz pair (u, e) solves
(I - PP')(V - eI)(I - PP') t = -r, P being all locked vectors and the block's Ritz vectors, by a few steps of MINRES; all of a
block's equations share their passes. When all wanted pairs are locked, the solver starts once more from
random vectors orthogonal to them; pairs that it finds to be larger take the place of smaller ones, until the
largest pair outside is known to be none of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toroid.llm.common import materialise

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries whose scaled value no longer fits a double exactly have no place on the grid.
FURTHEST = float(1 << 52)
#: Ritz pairs that are corrected together; dimensions of the search space besides locked vectors; steps of MINRES for each correction.
BLOCK, SPACE, INNER = 16, 48, 12
#: Tasks that add partial products up before the driver does.
FAN = 32
#: Residuals of double precision, relative to the largest eigenvalue.
PRECISION = 64 * np.finfo(float).eps
#: Eigenvalues below this share of the largest one count as zero; nothing can be scaled by them.
ZERO = 1e-12
OUTER = 500
#: Residual, relative to the largest eigenvalue, from which on products are taken anew.
NEAR = 1e-9
#: Residual, relative to the largest eigenvalue, at which the largest pair outside the locked ones is known well enough.
CHECK = 1e-4
#: Rows written at once.
ROWS_OUT = 2048

Product = Callable[[np.ndarray], np.ndarray]


def grid_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): vectors on the grid floor(64 c) + 1,000,000, written to the shared folder.

    Left out are vectors that are null, that hold a null, NaN, infinite or over-large (2**46) entry, and those whose length
    is not the most frequent one (of equally frequent lengths the largest counts). Empty vectors are left out too.
    """
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < FURTHEST / SCALE, F.lit(False)))
    x = F.transform(v, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))
    found = materialise(rows.where(good).select(F.col(id_col).alias("id"), x.alias("x")))
    usual = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.where(F.size("x") == usual["d"]) if usual else found


def _block(batch: pa.RecordBatch, d: int, column: str = "x") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], d: int, parts: int, kind: str = "double") -> np.ndarray | None:
    """The sum over all batches of part(x block), a flat array of `kind`; partial sums are added in the order of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_block(batch, d))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total])], ["task", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            held |= zip(batch.column(0).to_pylist(), (np.array(x.values) for x in batch.column(1)))
        if held:
            total = sum(held[k] for k in sorted(held))
            yield pa.RecordBatch.from_arrays([pa.array([min(held)], pa.int32()), pa.array([total])], ["task", "total"])

    schema = f"task int, total array<{kind}>"
    partial = rows.select("x").mapInArrow(run, schema)
    if parts > FAN:
        partial = partial.repartition(FAN, F.col("task") % FAN).mapInArrow(add, schema)
    found = sorted(partial.collect())
    return sum(np.array(r["total"]) for r in found) if found else None


@dataclass(frozen=True)
class Moments:
    """n vectors of d entries, their sums by entry as whole numbers, and the number of tasks that a pass takes."""

    n: int
    sums: list[int]
    parts: int

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean; whole parts are subtracted as whole numbers, so nothing is lost to the shift."""
        return (x - self.whole).astype(float) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over entries of (n x - S)**2, exact; null where it does not fit 64 bits."""
        about = (self.centred(x) ** 2).sum(1) * float(self.n) ** 2
        far = about > 9.2e18
        apart = np.where(far[:, None], 0, x - self.whole) * self.n - np.where(far[:, None], 0, self.rest)
        return pa.array((apart * apart).sum(1), mask=far)


def moments(rows: DataFrame) -> Moments | None:
    """Exact sums; the halves of each number are added apart, so no sum overflows below four billion rows a task."""
    first = rows.first()
    if first is None:
        return None
    d = len(first["x"])
    parts = rows.select(F.spark_partition_id().alias("p")).distinct().count()

    def part(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0)])

    found = [int(v) for v in _added(rows, part, d, parts, "bigint")]
    return Moments(found[0], [(a << 26) + b for a, b in zip(found[1 : d + 1], found[d + 1 :])], parts)


def covariance_product(rows: DataFrame, m: Moments) -> Product:
    """W -> V W for the covariance matrix V of the vectors, one pass over rows for each call."""
    d = len(m.sums)

    def product(w: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = m.centred(x)
            return (c.T @ (c @ w)).ravel()

        return _added(rows, part, d, m.parts).reshape(d, -1) / m.n

    return product


def _orthonormal(w: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of w's part orthogonal to `against` (orthonormal columns); what is nearly dependent goes."""
    kept = []
    for col in w.T:
        size = np.linalg.norm(col)
        if not np.isfinite(size) or size == 0:
            continue
        col = col / size
        for _ in range(3):
            col = col - against @ (against.T @ col)
            for k in kept:
                col = col - k * (k @ col)
            left = np.linalg.norm(col)
            if left < 1e-8:
                break
            col = col / left
        else:
            kept.append(col)
    return np.array(kept).T if kept else np.zeros((len(w), 0))


def minres(apply: Product, b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Minimal residual solutions of one symmetric system for each column of b; all columns share each product."""
    size = np.linalg.norm(b, axis=0)
    live = size > 0
    v_old, v, x = np.zeros_like(b), b / np.where(live, size, 1), np.zeros_like(b)
    w_old, w = np.zeros_like(b), np.zeros_like(b)
    beta, eta = size.copy(), size.copy()
    c_old, c, s_old, s = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    for _ in range(steps):
        if not live.any():
            break
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        d0, d2, d3 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        d1 = np.hypot(d0, beta_new)
        live &= d1 > 0
        d1 = np.where(d1 > 0, d1, 1)
        c_old, c, s_old, s = c, d0 / d1, s, beta_new / d1
        w_old, w = w, (v - d3 * w_old - d2 * w) / d1
        x = np.where(live, x + c * eta * w, x)
        eta = -s * eta
        live &= (abs(eta) > tolerance * size) & (beta_new > 1e-300)
        v_old, v, beta = v, p / np.where(beta_new > 1e-300, beta_new, 1), beta_new
    return x


def jacobi_davidson(product: Product, d: int, wanted: int, block: int = BLOCK, space: int = SPACE, inner: int = INNER, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues (falling) and their orthonormal eigenvectors (columns) of the symmetric,
    positive semidefinite matrix of dimension d that product() multiplies with. Eigenvalues may repeat."""
    wanted, rng = min(wanted, d), np.random.default_rng(seed)
    locked, values, checking = np.zeros((d, 0)), np.zeros(0), False

    def drawn() -> tuple[np.ndarray, np.ndarray]:
        q = _orthonormal(rng.standard_normal((d, min(d - locked.shape[1], block))), locked)
        return q, product(q)

    (q, aq), fresh = drawn(), True
    for outer in range(OUTER):
        h = q.T @ aq
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = q @ y, aq @ y
        residual = au - u * theta
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        scale = max(theta.max(initial=0), values.max(initial=0))
        whole = u.shape[1] + locked.shape[1] == d  # nothing is left to add: only rounding remains
        small = norms <= (1e-11 if whole else PRECISION) * scale
        done = len(small) if small.all() else int(np.argmin(small))
        if not checking:
            done = min(done, wanted - len(values))
        else:  # of the others, those that are larger than the least locked one take its place
            least = values.min()
            done = min(done, int((theta > least * (1 + 1e-9)).sum()))
            if theta[0] + norms[0] <= least + 1e-9 * scale and (whole or norms[0] <= CHECK * scale):
                break
        if done:
            locked, values = np.c_[locked, u[:, :done]], np.r_[values, theta[:done]]
            order = np.argsort(-values, kind="stable")[:wanted]
            locked, values = locked[:, order], values[order]
            u, au, theta, residual = u[:, done:], au[:, done:], theta[done:], residual[:, done:]
        if len(values) == wanted and (done or not checking):
            if wanted == d:
                break
            checking = True
            q, aq = drawn()
            continue
        if whole or not fresh and len(theta) and norms[done] <= NEAR * scale:  # rounding has piled up in products that were carried along
            q = _orthonormal(u, locked)
            aq, fresh = product(q), True
            continue
        p = min(block, len(theta))
        held = np.c_[locked, u[:, :p]]

        def corrected(t: np.ndarray) -> np.ndarray:
            t = t - held @ (held.T @ t)
            t = product(t) - t * theta[:p]
            return t - held @ (held.T @ t)

        right = held @ (held.T @ residual[:, :p]) - residual[:, :p]
        t = minres(corrected, right, inner, max(0.5 ** (outer + 1), 1e-4)) if p else right
        room = min(space, d - locked.shape[1])
        if u.shape[1] + p > room:  # restart with the leading Ritz vectors
            keep = max(p, room - p)
            u, au = u[:, :keep], au[:, :keep]
        new = _orthonormal(t, np.c_[locked, u])
        if not new.shape[1]:  # corrections add nothing: another direction
            new = _orthonormal(rng.standard_normal((d, 1)), np.c_[locked, u])
        q, fresh = np.c_[u, new], False
        aq = np.c_[au, product(new)] if new.shape[1] else au
    else:
        raise RuntimeError("the eigenvectors did not converge")
    return values, locked


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each remaining row and component: id, component, n, deviation, whitened, explained, identity_error.

    grid_vectors says which rows remain. Rows that repeat are all fitted and listed, null ids too. Components number from 1
    by falling eigenvalue; those with an eigenvalue of zero (a share of 1e-12 of the largest one) are not listed, as nothing can
    be scaled by them: so equal vectors, one vector or none give no rows. Where eigenvalues are equal any basis
    of their space is a result. deviation is null where it exceeds 64 bits. Columns other than the two named ones are not read.
    """
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    nothing = rows.sparkSession.createDataFrame([], schema)
    x = grid_vectors(rows, id_col, vector_col)
    m = moments(x)
    if m is None:
        return nothing
    d = len(m.sums)
    trace = float(_added(x, lambda b: np.array([(m.centred(b) ** 2).sum()]), d, m.parts)[0]) / m.n
    if not trace:
        return nothing
    values, vectors = jacobi_davidson(covariance_product(x, m), d, components)
    kept = values > ZERO * values[0]
    values, vectors = values[kept], vectors[:, kept]
    k, project = len(values), vectors / np.sqrt(values)

    def square(b: np.ndarray) -> np.ndarray:
        y = m.centred(b) @ project
        return (y.T @ y).ravel()

    error = float(abs(_added(x, square, d, m.parts).reshape(k, k) / m.n - np.eye(k)).max())
    explained, n = values / trace, m.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                own, count = _block(part, d), part.num_rows
                each = pa.array(np.repeat(np.arange(count), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, n)),
                        m.deviation(own).take(each), pa.array((m.centred(own) @ project).ravel()), pa.array(np.tile(explained, count)), pa.array(np.full(count * k, error)),
                    ],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.mapInArrow(run, schema)

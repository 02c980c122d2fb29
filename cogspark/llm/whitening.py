"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows X that are fitted to are the different integer vectors, less their means, in a table in the shared folder.
Each step is one Spark pass: every task forms X v for its blocks of rows, what the left vectors found so far have in
common with it, and X' (X v); the sums, as long as a vector plus the number of steps, are added up by Spark. The left
vectors u_j are never stored, as each is X z_j for a short z_j that the driver keeps: the tasks form them anew from
their rows. That gives alpha, the new left vector free of all earlier ones, X' u and with it beta and the new right
vector, which is made orthogonal to all earlier ones twice over. The singular values of the small bidiagonal matrix
are the deviations, its right vectors, turned by the Lanczos vectors, the components.

The steps end when the wanted components no longer change and nothing that was missed could be among them (what is
left of the sum of squares is smaller than the last wanted one), or when the right vectors span the whole space. After
a breakdown the search goes on from a new direction, so repeated deviations are all found.

Defined cases: vectors that are null or hold null or non-finite components are dropped; shorter vectors count as ending
in zeros; components without deviation are left out, so a table of one different vector, an empty one, or vectors of
length 0 give no rows; rows without an id stay, with a null id; repeated rows each get their rows; components whose
deviation is less than 1e-10 of the largest one's are beyond doubles and count as none, and from 1e-8 on downwards
their whitened values lose digits (identity_error says so); numbers beyond a
long are cut to its range; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import matrix, quantised, tidy, whole, written

#: Rows that a task multiplies at once.
ROWS = 8192
#: Singular values below this share of the largest count as nothing.
NOTHING = 1e-10
_LONG = (1 << 63) - 1


def fit_rows(vectors: DataFrame, vector: str, scale: float) -> tuple[DataFrame, int]:
    """The different vectors floor(scale * c), as doubles padded to the longest, and their length."""
    rows, d = quantised(vectors.select(F.col(vector).cast("array<double>").alias("v")).filter(whole("v")), scale)
    return written(rows.distinct(), "whiten"), d


def totals(fitted: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of fit rows and the exact sum of each dimension."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column(0), d)
            n += len(x)
            if len(x) and np.abs(x).max() * len(x) < 2.0**53:
                sums = [a + int(b) for a, b in zip(sums, x.sum(0))]
            else:
                sums = [a + sum(int(y) for y in x[:, i]) for i, a in enumerate(sums)]
        if n:
            # two limbs, so that Spark's sums stay exact
            cells = [(-1, n, 0), *((i, s % (1 << 32), s >> 32) for i, s in enumerate(sums))]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), *(pa.array([str(c[k]) for c in cells]) for k in (1, 2))], ["k", "low", "high"])

    out = fitted.mapInArrow(run, "k int, low string, high string").groupBy("k").agg(F.sum(F.col("low").cast("decimal(38,0)")), F.sum(F.col("high").cast("decimal(38,0)"))).collect()
    by = {k: int(low) + (int(high) << 32) for k, low, high in out}
    return by.get(-1, 0), [by.get(i, 0) for i in range(d)]


def _summed(fitted: DataFrame, d: int, mean: np.ndarray, width: int, of) -> np.ndarray:
    """The sum over all rows of of(centred block), `width` numbers, added up on the executors and by Spark."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                total += of(matrix(batch.column(0).slice(lo, ROWS), d) - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["k", "v"])

    out = np.zeros(width)
    for k, v in fitted.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v")).collect():  # `width` rows
        out[k] = v
    return out


def _free_of(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """x less what lies in the columns of basis, twice over."""
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


def bidiagonalise(fitted: DataFrame, d: int, n: int, mean: np.ndarray, k: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(components (d, k'), singular values, steps, sum of squares) of the centred fit rows, k' <= k."""
    rng = np.random.default_rng(seed)
    energy = float(_summed(fitted, d, mean, 1, lambda x: np.array([(x * x).sum()]))[0])
    right, z, forward = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v_j, u_j = X z_j, X' u_j
    alphas, betas = [], []
    if energy <= 0:
        return right, np.zeros(0), 0, 0.0
    v, beta, fresh = rng.standard_normal(d), 0.0, True
    v /= np.linalg.norm(v)
    floor = np.sqrt(energy) * NOTHING
    while True:
        new = v - beta * z[:, -1] if beta else v  # X new = X v less its known part of the left vector before
        right = np.column_stack([right, v])
        steps = right.shape[1]
        while True:

            def of(x, new=new, held=z.copy()):
                u, w = x @ held, x @ new
                return np.concatenate([x.T @ w, u.T @ w, [w @ w]])

            sums = _summed(fitted, d, mean, d + steps, of)
            onto, common, size = sums[:d], sums[d : d + steps - 1], sums[-1]
            new, image, alpha = new - z @ common, onto - forward @ common, np.sqrt(max(0.0, size - common @ common))
            if alpha**2 >= 0.5 * size or np.sqrt(size) <= floor:
                break  # else too much was taken off for the sums to be exact: once more
        if alpha > floor:
            new, image = new / alpha, image / alpha
        else:
            alpha, new, image = 0.0, np.zeros(d), np.zeros(d)
        z, forward = np.column_stack([z, new]), np.column_stack([forward, image])
        alphas.append(alpha)
        betas.append(beta)  # of this right vector with the left vector before
        rest = _free_of(image, right)
        beta = float(np.linalg.norm(rest))
        small = np.diag(alphas) + np.diag(betas[1:], 1)
        p, s, qt = np.linalg.svd(small)
        if steps == d or fresh and not alpha:  # a random direction of what is left shows that nothing is
            break
        left = energy - float((s**2).sum())
        still = beta * np.abs(p[-1, :k])
        if steps >= k and s[k - 1] > floor and left < s[k - 1] ** 2 and (still <= 1e-15 * s[0]).all():
            break
        fresh = beta <= floor
        if fresh:
            beta, rest = 0.0, _free_of(rng.standard_normal(d), right)
        v = _free_of(rest / np.linalg.norm(rest), right)
        v /= np.linalg.norm(v)
    keep = min(k, int((s > s[0] * NOTHING).sum()))
    turn = right @ qt[:keep].T
    return turn / np.linalg.norm(turn, axis=0), s[:keep], steps, energy


class Whitening:
    """A fitted whitening: n, sums, mean, components (d, k), deviations' roots (eigenvalues), explained shares."""

    def __init__(self, fitted: DataFrame, d: int, k: int):
        self.d, (self.n, self.sums) = d, totals(fitted, d) if d else (0, [])
        self.mean = np.array([float(Fraction(s, self.n)) for s in self.sums]) if self.n else np.zeros(d)
        self.components, s, self.steps, energy = bidiagonalise(fitted, d, self.n, self.mean, k) if self.n > 1 else (np.zeros((d, 0)), np.zeros(0), 0, 0.0)
        self.eigenvalues = s**2 / max(self.n, 1)
        self.explained = s**2 / energy if energy else np.zeros(0)
        self.identity_error = self._error(fitted)

    @property
    def k(self) -> int:
        return self.components.shape[1]

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred @ self.components) / np.sqrt(self.eigenvalues)

    def _error(self, fitted: DataFrame) -> float:
        """The largest absolute entry of the covariance of the whitened fit rows less the identity."""
        if not self.k:
            return 0.0
        k, components, root = self.k, self.components, np.sqrt(self.eigenvalues)
        middle = _summed(fitted, self.d, self.mean, k, lambda x: ((x @ components) / root).sum(0)) / self.n

        def of(x):
            y = (x @ components) / root - middle
            return (y.T @ y).ravel()

        return float(np.abs(_summed(fitted, self.d, self.mean, k * k, of).reshape(k, k) / self.n - np.eye(k)).max())


def fit(vectors: DataFrame, vector: str = "embedding", k: int = 4, scale: float = 256.0) -> Whitening:
    """Fits to the different vectors floor(scale * c)."""
    return Whitening(*fit_rows(vectors, vector, scale), k)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - S)^2 of each row, exact."""
    most = float(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if most * most * max(1, len(sums)) < 2.0**62:
        y = x.astype(np.int64) * n - np.array(sums, np.int64)
        return (y * y).sum(1).tolist()
    return [min(_LONG, sum((n * int(c) - s) ** 2 for c, s in zip(row, sums))) for row in x]


def transform(vectors: DataFrame, model: Whitening, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each whole vector and component."""
    d, n, sums, k, error = model.d, model.n, model.sums, model.k, model.identity_error
    mean, components, root, explained = model.mean, model.components, np.sqrt(model.eigenvalues), model.explained

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows if k else 0, ROWS):
                part = batch.slice(lo, ROWS)
                x = matrix(part.column(1), d)
                y = ((x - mean) @ components) / root
                each = np.repeat(np.arange(len(x)), k)
                deviation = pa.array(_deviations(x, n, sums), pa.int64())
                number = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(each)), pa.array(number), pa.array(np.full(len(each), n)), deviation.take(pa.array(each)), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(whole("v"))
    return quantised(rows, scale)[0].mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitening(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 4, scale: float = 256.0) -> DataFrame:
    """Fits to the different vectors and whitens every row: see transform()."""
    return transform(vectors, fit(vectors, vector, k, scale), id, vector, scale)

"""Embedding whitening: principal components by Jacobi-Davidson, without ever forming the covariance matrix.

Vectors are stored once as rows of whole numbers. The only thing done with them is a block of centred products
``V b = 1/n sum (x - m)((x - m) . b)``: tasks multiply their rows and give one small block each, the driver adds
these up. On the driver lies a search space of a few dozen vectors as long as one embedding. A round solves the
small projected problem (Rayleigh-Ritz), locks the leading Ritz pairs whose residual has reached double precision,
and widens the space by approximate solutions of the correction equations

    (1 - Q Q') (V - theta) (1 - Q Q') t = -r

of the leading pairs, where Q holds the locked vectors and the pair's own. An inner MINRES solves them in lock
step, so that one job multiplies for all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import table
from cohortspark.sources.io import materialize

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000
#: Vectors beyond the wanted ones that are searched for as well, which keeps close eigenvalues apart.
GUARD = 4
#: Inner steps of a correction at most; vectors in the search space at most; rounds at most.
INNER = 8
SPACE = 96
ROUNDS = 200
#: Residuals of locked pairs, as a multiple of the greatest eigenvalue.
PRECISION = 16 * np.finfo(float).eps
#: Residuals that are taken where they no longer fall, as the products' own rounding is reached.
ROUNDING = 4096 * np.finfo(float).eps
#: Blocks that a product sends to the driver hold at most this many bytes together.
PARTIAL_BYTES = 64 << 20
#: Greatest size of an entry after scaling; doubles are whole up to here.
LARGEST = float(1 << 53)

Product = Callable[[np.ndarray], np.ndarray]


def orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The part of the block's columns that is new to the given orthonormal ones, orthonormal; lost columns go."""
    kept: list[np.ndarray] = []
    basis = np.column_stack([*against]) if against else np.zeros((len(block), 0))
    for column in block.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        column = column / size
        for _ in range(3):
            column = column - basis @ (basis.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            kept.append(column)
            basis = np.column_stack([basis, column])
    return np.array(kept).T.reshape(len(block), -1)


def minres(apply: Product, right: np.ndarray, steps: int, least: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one for each column of ``right``, in lock step.

    Ends after ``steps`` products, or when each residual is below ``least`` times its right side.
    """
    size = np.linalg.norm(right, axis=0)
    live = size > 0
    v, v_before = np.where(live, right / np.where(live, size, 1), 0), np.zeros_like(right)
    w, w_before, x = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    beta, eta = np.zeros(right.shape[1]), size.copy()
    c, c_before, s, s_before = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        p = apply(v) - beta * v_before
        alpha = np.einsum("ij,ij->j", v, p)
        p -= alpha * v
        beta_next = np.linalg.norm(p, axis=0)
        diagonal = c * alpha - c_before * s * beta
        rho = np.hypot(diagonal, beta_next)
        live = live & (rho > 0)
        safe = np.where(rho > 0, rho, 1)
        w_next = (v - (s * alpha + c_before * c * beta) * w - s_before * beta * w_before) / safe
        c_before, s_before = c, s
        c, s = diagonal / safe, beta_next / safe
        x = np.where(live, x + c * eta * w_next, x)
        eta = -s * eta
        w_before, w = w, w_next
        live = live & (beta_next > 0) & (np.abs(eta) > least * size)
        if not live.any():
            break
        v_before, v = v, np.where(live, p / np.where(beta_next > 0, beta_next, 1), 0)
        beta = np.where(live, beta_next, 0)
    return x


def jacobi_davidson(product: Product, size: int, wanted: int, seed: int = 7, inner: int = INNER, space: int = SPACE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """The greatest eigenvalues of a symmetric operator, falling, their unit vectors, and the worst residual.

    The residual is a multiple of the greatest eigenvalue. Locked pairs are taken up again if a greater one shows
    up later. Where a pair's residual no longer falls, it is locked within ``ROUNDING``. Without convergence in
    ``rounds`` an error is raised.
    """
    wanted = min(wanted, size)
    width = min(size, wanted + GUARD)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    basis = orthonormal(np.random.default_rng(seed).standard_normal((size, width)))
    image = product(basis)
    worst, stale, best = math.inf, 0, math.inf
    for _ in range(rounds):
        theta, small = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, small = theta[::-1], small[:, ::-1]
        basis, image = basis @ small, image @ small
        residual = image - basis * theta
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        top = max(abs(theta[0]), *values, np.finfo(float).tiny) if len(values) else max(abs(theta[0]), np.finfo(float).tiny)
        open_ = wanted - locked.shape[1]
        whole = basis.shape[1] + locked.shape[1] >= size
        worst = float(norms[:open_].max() / top) if open_ else 0.0
        stale, best = (0, worst) if worst < 0.5 * best else (stale + 1, best)
        ready = 0
        while ready < min(open_, basis.shape[1]) and (norms[ready] <= PRECISION * top or (stale >= 3 and norms[ready] <= ROUNDING * top)):
            ready += 1
        if ready:  # in order: a pair is locked after all greater ones
            locked, values = np.column_stack([locked, basis[:, :ready]]), np.r_[values, theta[:ready]]
            basis, image, theta, residual = basis[:, ready:], image[:, ready:], theta[ready:], residual[:, ready:]
            best, stale = math.inf, 0
        missed = len(theta) > 0 and len(values) > 0 and theta[0] > values.min() + PRECISION * top
        if locked.shape[1] >= wanted and not missed:
            break
        if missed:
            basis, locked, values = orthonormal(np.column_stack([locked, basis])), np.zeros((size, 0)), np.zeros(0)
            image = product(basis)
            continue
        if not basis.shape[1]:
            basis = orthonormal(np.random.default_rng(seed + locked.shape[1]).standard_normal((size, width)), locked)
            image = product(basis)
            continue
        targets = min(width, basis.shape[1])
        own, shift = basis[:, :targets], theta[:targets]

        def projected(block: np.ndarray) -> np.ndarray:
            block = block - locked @ (locked.T @ block)
            return block - own * np.einsum("ij,ij->j", own, block)

        right = -projected(residual[:, :targets])
        steps = minres(lambda b: projected(product(projected(b)) - shift * projected(b)), right, inner, 1e-3)
        if basis.shape[1] + targets > space:  # start again from the best vectors
            basis = orthonormal(basis[:, : 2 * width], locked)
            image = product(basis)  # anew, as turned images gather rounding
        new = orthonormal(np.column_stack([projected(steps), right]) if whole else projected(steps), locked, basis)
        if not new.shape[1] and not whole:
            new = orthonormal(np.random.default_rng(seed + basis.shape[1]).standard_normal((size, targets)), locked, basis)
        if new.shape[1]:
            basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
        else:  # nothing is left to search; products of the turned basis are taken anew
            basis = orthonormal(basis, locked) if locked.shape[1] else orthonormal(basis)
            image = product(basis)
    else:
        raise ArithmeticError(f"{wanted - len(values)} of {wanted} pairs have not converged; the worst residual is {worst:.1e}.")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order], worst


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): the usable vectors as whole numbers. Left out: null vectors, null or non-finite entries, no entries, and entries of 2^53 or more after scaling."""
    c = F.col(vector_col).cast("array<double>")
    usable = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST / SCALE / 2))
    rows = vectors.select(F.col(id_col).alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & usable)
    return rows.select("vec_id", F.transform("c", lambda e: F.floor(e * SCALE) + SHIFT).alias("x"))


class Centred:
    """Products with the covariance of stored rows of whole numbers, centred before they are multiplied."""

    def __init__(self, rows: DataFrame, size: int):
        self.rows, self.size = rows.select("x"), size
        self.n, self.sums, squares = 0, [0] * size, 0
        for r in self._blocks(self._moments, "n long, sums array<decimal(38,0)>, squares decimal(38,0)", 16 * size).collect():
            self.n += r.n
            self.sums = [a + int(b) for a, b in zip(self.sums, r.sums, strict=True)]
            squares += int(r.squares)
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(size)
        # n^2 times the trace, exact
        self.trace = (self.n * squares - sum(s * s for s in self.sums)) / self.n**2 if self.n else 0.0

    def _blocks(self, run, schema: str, size: int) -> DataFrame:
        """One row a task, from as many tasks as the driver has room for."""
        return self.rows.coalesce(max(16, PARTIAL_BYTES // size)).mapInArrow(run, schema)

    @staticmethod
    def matrix(batch: pa.RecordBatch, at: int = 0) -> np.ndarray:
        column = batch.column(at)
        return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    @property
    def _moments(self):
        size, matrix = self.size, self.matrix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums, squares = 0, [0] * size, 0
            for batch in batches:
                x = matrix(batch)
                if not len(x):
                    continue
                exact = np.abs(x).max() < 1 << 24  # else sums of a batch may pass 64 bits
                x = x if exact else x.astype(object)
                n += len(x)
                sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0), strict=True)]
                squares += int((x * x).sum())
            from decimal import Decimal

            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0))), pa.array([Decimal(squares)], pa.decimal128(38, 0))], names=["n", "sums", "squares"])

        return run

    def _sum(self, block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum over all rows of what ``block`` gives for a batch of centred rows."""
        mean, matrix = self.mean, self.matrix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    total += block(matrix(batch) - mean)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        found = self._blocks(run, "total binary", 8 * shape[0] * shape[1]).collect()
        return np.sum([np.frombuffer(r.total).reshape(shape) for r in found], axis=0)

    def __call__(self, block: np.ndarray) -> np.ndarray:
        return self._sum(lambda x: x.T @ (x @ block), block.shape) / self.n

    def whitened_error(self, axes: np.ndarray) -> float:
        """Largest entry of the covariance of the projections on ``axes`` (already divided) minus the identity."""
        k = axes.shape[1]
        mean = self._sum(lambda x: (x @ axes).sum(axis=0, keepdims=True), (1, k)) / self.n

        def products(x: np.ndarray) -> np.ndarray:
            z = x @ axes - mean
            return z.T @ z

        return float(np.abs(self._sum(products, (k, k)) / self.n - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable vector and component.

    ``x = floor(1024 c) + 100000``; ``deviation`` is the exact sum of squares of ``n x - S``; ``whitened`` the
    projection of ``x - S/n`` on the component over the root of its variance, null for a component without
    variance; ``explained`` that variance over the trace (0 if the trace is 0); ``identity_error`` one value, over
    the components with variance. Components have falling variance; there are no more than dimensions.

    Left out are null vectors and vectors with null or non-finite entries, without entries, or with entries of
    2^52 or more after scaling. All others count, repeated rows each for itself, and rows without an id as well. Vectors of different
    lengths raise an error. An empty table gives no rows.
    """
    rows = materialize(scaled(vectors, id_col, vector_col).withColumn("vec_id", F.col("vec_id").cast("long")))
    spark, sizes = rows.sparkSession, rows.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if sizes.low is None:
        return spark.createDataFrame([], WHITENED)
    if sizes.low != sizes.high:
        raise ValueError(f"Vectors have from {sizes.low} to {sizes.high} entries.")
    size = sizes.high
    centred = Centred(rows, size)
    values, axes, _ = jacobi_davidson(centred, size, components) if centred.trace > 0 else (np.zeros(min(components, size)), np.eye(size)[:, : min(components, size)], 0.0)
    varied = values > 1e-12 * centred.trace
    divided = axes[:, varied] / np.sqrt(values[varied])
    error = centred.whitened_error(divided) if varied.any() else 0.0
    explained = values / centred.trace if centred.trace > 0 else np.zeros(len(values))
    n, sums, mean, matrix, k = centred.n, np.array(centred.sums, object), centred.mean, Centred.matrix, len(values)
    largest = max(abs(s) for s in centred.sums) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = matrix(part, 1)
                if size * (n * int(np.abs(x).max()) + int(largest)) ** 2 < 1 << 62:
                    deviation = [int(v) for v in ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1)]
                else:
                    deviation = ((n * x.astype(object) - sums) ** 2).sum(axis=1).tolist()
                z = np.full((len(x), k), np.nan)
                z[:, varied] = (x - mean) @ divided
                flat = z.ravel()
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(flat), n, np.int64)),
                    pa.array([Decimal(d) for d in deviation for _ in range(k)], pa.decimal128(38, 0)), pa.array(flat, mask=np.tile(~varied, len(x))), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(flat), error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, WHITENED)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all usable embeddings; a deviation that passes 64 bits is null here, not in ``whiten``."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))

"""Whitening of embeddings along the leading components, which LOBPCG finds by covariance-block products.

The covariance itself is never formed: a pass over the distinct vectors gives its product with a block
of directions, summed on the executors, so that d times the block's width numbers reach the driver
however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.storage import durable

#: Directions that are iterated for each component that is asked for, and the most passes.
GUARD, MOST_PASSES = 4, 500
#: Residual norms against the greatest eigenvalue: where the iteration may stop, and what is certified.
TOLERANCE, CERTIFIED = 1e-14, 1e-10
#: Components of a smaller share of the greatest eigenvalue are left out: no double tells them from zero.
LEAST_SHARE = 1e-10


@dataclass(frozen=True)
class Components:
    """``n`` distinct vectors with sums ``sums``; unit ``directions`` (d x k) of eigenvalues ``values``; ``residual`` is the greatest residual norm over the greatest eigenvalue."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x): entries times ``scale``, rounded down to longs. Vectors that are null or empty, or hold a null or an entry that is not finite, are dropped."""
    entries = F.col("embedding")
    finite = F.forall(entries, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    rows = embeddings.select("vec_id", "embedding").where((F.size(entries) > 0) & finite)
    return rows.select("vec_id", F.transform(entries, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(vectors: DataFrame, size: int, kind: str, add) -> np.ndarray:
    """The sum over all rows of ``add(x)``, ``size`` numbers for each block of vectors; partial sums of tasks meet place by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = add(batch)
                if total is not None and kind == "long" and (np.abs(total.astype(float) + part) > 2.0**62).any():
                    raise OverflowError("sums of vectors are beyond 64 bits")
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "s"])

    parts = vectors.mapInArrow(run, f"place int, s {kind}")
    got = parts.groupBy("place").agg(F.sum("s").alias("s")).orderBy("place").toArrow()
    return got.column("s").to_numpy()


def _products(vectors: DataFrame, mean: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over all rows of c (c . z), c being the centred row, and of the squares of c."""
    d, m = z.shape

    def add(batch: pa.RecordBatch) -> np.ndarray:
        c = _matrix(batch, d) - mean
        return np.append((c.T @ (c @ z)).ravel(), (c * c).sum())

    got = _summed(vectors, d * m + 1, "double", add)
    return got[:-1].reshape(d, m), float(got[-1])


def _orthonormal(z: np.ndarray, block: np.ndarray, least: float) -> np.ndarray:
    """``z`` and what ``block`` adds to its span, as unit vectors; columns of norm ``least`` or below add nothing."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > least] / norms[norms > least]
    for _ in range(2):
        block = block - z @ (z.T @ block)
    if block.shape[1] and z.shape[1] < z.shape[0]:
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        u = u[:, s > 1e-10][:, : z.shape[0] - z.shape[1]]
        u = u - z @ (z.T @ u)
        z = np.hstack([z, np.linalg.qr(u)[0]])
    return z


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Each vector of the most frequent size once, as a written table; of equally frequent sizes the least."""
    once = durable(vectors.select("x").distinct(), "whitening-fit")
    first = once.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return once.where(F.size("x") == (first["d"] if first else 0))


def fit_components(fit: DataFrame, k: int = 4, seed: int = 7) -> Components | None:
    """The k leading components of the rows of ``fit`` (``distinct_vectors``); fewer if the rest have no variance, None without rows.

    LOBPCG over a block of ``GUARD`` times k directions: each pass multiplies the covariance with an
    orthonormal basis of iterate, residuals and previous directions, and Rayleigh-Ritz on that basis
    gives the next of each. It goes on until the residuals of the k components reach ``TOLERANCE`` times
    the greatest eigenvalue, or no longer fall; a last pass over the iterate alone certifies them.
    """
    head = fit.select(F.size("x").alias("d")).first()
    if head is None:
        return None
    d = head["d"]

    def count(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch, d)
        if np.abs(x.astype(float)).sum(0).max() > 2.0**62:
            raise OverflowError("sums of vectors are beyond 64 bits")
        return np.append(x.sum(0), len(x))

    *sums, n = (int(s) for s in _summed(fit, d + 1, "long", count))
    mean = np.array([s / n for s in sums])
    m = min(d, GUARD * k)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    residuals, previous = np.zeros((d, 0)), np.zeros((d, 0))
    best, since, trace = np.inf, 0, 0.0
    for passes in range(1, MOST_PASSES + 1):
        z = _orthonormal(x, residuals, np.finfo(float).tiny)
        z = _orthonormal(z, previous, np.finfo(float).tiny)
        av, squares = _products(fit, mean, z)
        av, trace = av / n, squares / n
        g = z.T @ av
        values, c = np.linalg.eigh((g + g.T) / 2)
        values, c = values[::-1][:m], c[:, ::-1][:, :m]
        inside = x.shape[1]
        x, ax = z @ c, av @ c
        previous = z[:, inside:] @ c[inside:]
        residuals = ax - x * values
        if values[0] <= 0:
            break
        asked = values[:k] > LEAST_SHARE * values[0]
        worst = np.linalg.norm(residuals[:, :k][:, asked], axis=0).max() / values[0]
        best, since = (worst, 0) if worst < best / 2 else (best, since + 1)
        if worst <= TOLERANCE or since >= 3 and best <= CERTIFIED:
            break
    values, x = values[:k], x[:, :k]
    held = (values > LEAST_SHARE * values[0]) & (values > 0)
    values, x = values[held], np.linalg.qr(x[:, held])[0] if held.any() else x[:, held]
    if not len(values):
        return Components(n, tuple(sums), x, values, trace, 0.0, 0.0, passes)
    ax = _products(fit, mean, x)[0] / n
    values = np.einsum("ij,ij->j", x, ax)
    residual = float(np.linalg.norm(ax - x * values, axis=0).max() / values[0])
    if residual > CERTIFIED:
        raise ArithmeticError(f"residuals of {residual:.2g} after {passes} passes")
    scaled = x / np.sqrt(values)
    means = _summed(fit, len(values), "double", lambda batch: ((_matrix(batch, d) - mean) @ scaled).sum(0)) / n

    def squares_of(batch: pa.RecordBatch) -> np.ndarray:
        w = (_matrix(batch, d) - mean) @ scaled - means
        return (w.T @ w).ravel()

    covariance = _summed(fit, len(values) ** 2, "double", squares_of).reshape(len(values), -1) / n
    return Components(n, tuple(sums), x, values, trace, residual, float(np.abs(covariance - np.eye(len(values))).max()), passes)


def whiten(vectors: DataFrame, fitted: Components | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component, numbered from 1.

    ``vectors`` are (vec_id, x). Rows of another size than the fitted one have no place in its space
    and are dropped; repeated rows and null ids stay. ``deviation`` is exact, and one beyond 64 bits raises.
    """
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], schema)
    d, k, n = len(fitted.sums), len(fitted.values), fitted.n
    mean, sums, scaled = fitted.mean, np.array(fitted.sums, np.int64), fitted.directions / np.sqrt(fitted.values)
    shares = fitted.values / fitted.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch, d)
            if ((n * x.astype(float) - sums) ** 2).sum(1).max() > 2.0**62:
                raise OverflowError("a deviation is beyond 64 bits")
            deviation = ((n * x - sums) ** 2).sum(1)
            whitened = (x - mean) @ scaled
            rows = len(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                    pa.array(np.repeat(deviation, k)), pa.array(whitened.ravel()), pa.array(np.tile(shares, rows)), pa.array(np.full(rows * k, fitted.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.where(F.size("x") == d).mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four components of all ``embeddings``."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whiten(vectors, fit_components(distinct_vectors(vectors)))

"""Whitening of vectors by matrix-free block subspace iteration.

Entries are taken as integers x = floor(64 * c) + 1000000.  The covariance V of the x-vectors is never formed: one pass over the rows
takes a block Q of orthonormal columns to V Q = Xᵀ(X Q) / n on centred rows, each task folding its rows into one d x b matrix.  In
the driver, which holds such matrices only (d rows, at most ``OVERSAMPLE`` * k columns, however many vectors there are), a
Rayleigh-Ritz step turns V Q into approximate eigenpairs and their residuals |V q - e q|; QR of V Q is the next block.  Passes end
once the residuals certify all k components.  Where the block is as wide as the vectors are long, one pass certifies.

Sums, and with them the centre, the trace and the deviations, are whole numbers and exact; rows are centred before anything is
multiplied, by subtracting S/n from x without its constant part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.llm.common import bound_batches

SCALE, SHIFT = 64, 1_000_000
#: Columns of the block for each component sought.  The spectra of embeddings are flat, and a pass shrinks the error by the ratio of the
#: first eigenvalue outside the block to the last one sought; reading the vectors again costs more than a wider block.
OVERSAMPLE = 2
#: A residual certifies its component if it is at most this part of the largest eigenvalue (and never below rounding: 8 eps d).
TOLERANCE = 1e-13
#: Passes after which the iteration gives up with an error.
MOST_PASSES = 2000
#: Eigenvalues below this part of the largest one are taken as zero.
RANK = 1e-12
#: Partial matrices meet in so many tasks before they reach the driver.
FAN_IN = 16
SAFE = 2.0**61


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """floor(64 c) of every entry, in doubles, which hold them exactly."""
    flat = np.asarray(column.flatten(), np.float64)
    return np.floor(SCALE * flat).reshape(-1, d)


def _moments(d: int):
    """Rows (place, number of vectors, sum, sum of squares), one a task and place; whole numbers as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, [0] * d, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            if not len(x):
                continue
            n += len(x)
            if np.abs(x).max() ** 2 * len(x) < SAFE:
                whole = x.astype(np.int64)
                added, more = whole.sum(0).tolist(), (whole * whole).sum(0).tolist()
            else:
                big = [[int(v) for v in row] for row in x]
                added, more = [sum(c) for c in zip(*big)], [sum(v * v for v in c) for c in zip(*big)]
            total = [a + b for a, b in zip(total, added)]
            squares = [a + b for a, b in zip(squares, more)]
        if n:
            yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(str, total)), pa.array(map(str, squares))], names=["place", "n", "s", "q"])

    return run


def _folded(rows: DataFrame, d: int, fold: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of ``fold(batch)``, an array of ``size`` doubles; at most FAN_IN of them reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                acc += fold(_matrix(batch.column(0), d)).ravel()
        yield pa.record_batch([pa.array([acc.tobytes()], pa.binary())], names=["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                acc += np.frombuffer(part)
        yield pa.record_batch([pa.array([acc.tobytes()], pa.binary())], names=["part"])

    parts = rows.select("_v").mapInArrow(partial, "part binary").repartition(FAN_IN).mapInArrow(add, "part binary").collect()
    return np.sum([np.frombuffer(bytes(r["part"])) for r in parts], axis=0)


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues (falling) and unit eigenvectors (columns) of a symmetric d x d operator, and the passes it took.

    ``product(Q)`` gives V Q.  Components of (nearly) no variance are left out.
    """
    k = min(k, d)
    width = min(d, OVERSAMPLE * k)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    for done in range(1, MOST_PASSES + 1):
        z = product(q)
        inner = q.T @ z
        theta, y = np.linalg.eigh((inner + inner.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, image = q @ y, z @ y
        most = max(theta[0], 0.0)
        residual = np.linalg.norm(image[:, :k] - ritz[:, :k] * theta[:k], axis=0)
        if (residual <= max(TOLERANCE, 8 * np.finfo(float).eps * d) * most).all():
            live = theta[:k] > RANK * most
            return theta[:k][live], ritz[:, :k][:, live], done
        q = np.linalg.qr(image)[0]
    raise RuntimeError(f"the residuals of {k} components aren't certified after {MOST_PASSES} passes: {residual.max()} against {most}")


def _whitened(rows: DataFrame, kind: str, d: int, k: int) -> DataFrame | None:
    """The result for the vectors of one length; None if they have no variance."""
    places = rows.select("_v").mapInArrow(_moments(d), "place int, n long, s string, q string")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c)
    found = {r["place"]: r for r in places.groupBy("place").agg(F.sum("n").alias("n"), whole("s"), whole("q")).collect()}
    n, sums = found[0]["n"], [int(found[j]["s"]) for j in range(d)]
    trace = sum(n * int(found[j]["q"]) - sums[j] ** 2 for j in range(d)) / n**2
    mean = np.array([s / n for s in sums])

    def product(q: np.ndarray) -> np.ndarray:
        def fold(x: np.ndarray) -> np.ndarray:
            x = x - mean
            return x.T @ (x @ q)

        return _folded(rows, d, fold, q.size).reshape(q.shape) / n

    values, vectors, _ = eigenpairs(product, d, k)
    if not len(values):
        return None
    turn = vectors / np.sqrt(values)
    m = len(values)

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    sums_of_w = _folded(rows, d, spread, m + m * m)
    centre = sums_of_w[:m] / n
    error = float(np.abs(sums_of_w[m:].reshape(m, m) / n - np.outer(centre, centre) - np.eye(m)).max())
    largest = max(abs(s) for s in sums)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            if not len(x):
                continue
            if d * (n * np.abs(x).max() + largest) ** 2 < SAFE:
                away = n * x.astype(np.int64) - np.array(sums, np.int64)
                deviation = (away * away).sum(1).tolist()
            else:
                deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
            w = (x - mean) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, m), pa.int32()), pa.array(w.ravel()))
            yield pa.record_batch([batch.column(0), pa.array(map(str, deviation)), lists], names=["_id", "_deviation", "_w"])

    turned = rows.select("_id", "_v").mapInArrow(rotate, f"_id {kind}, _deviation string, _w array<double>")
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    return turned.select("_id", "_deviation", F.posexplode("_w").alias("_at", "_whitened")).select(
        "_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("_deviation").cast("decimal(38,0)").alias("deviation"),
        F.col("_whitened").alias("whitened"),
        F.element_at(explained, F.col("_at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def whiten(vectors: DataFrame, k: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every vector in the ``k`` leading principal components: one row a vector and component.

    Columns: id, component (from 1), n, deviation (decimal, exact: the sum over places of (n x - S)^2), whitened, explained (eigenvalue
    over trace), identity_error.  Vectors that are null, empty or hold a null, a non-finite entry or one beyond the range
    of 64-bit x take no part.  Null ids are kept; repeated rows count as often as they occur.  Vectors of several lengths are
    fitted length by length.  Components without variance can't be scaled and are left out, so a single vector, equal vectors
    and an empty table give no rows.
    """
    bound_batches(vectors.sparkSession)
    kind = vectors.select(id_col).schema[0].dataType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(2.0**57)))
    rows = vectors.select(F.col(id_col).alias("_id"), v.alias("_v")).where(F.col(vector_col).isNotNull() & (F.size(v) > 0) & ~bad)
    lengths = [r["d"] for r in rows.select(F.size("_v").alias("d")).distinct().orderBy("d").collect()]
    out = None
    for d in lengths:
        part = _whitened(rows.where(F.size("_v") == d) if len(lengths) > 1 else rows, kind, d, k)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        schema = f"_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        out = vectors.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("_id", id_col)

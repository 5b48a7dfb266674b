"""Whitened embeddings: leading eigenvectors of the covariance by block Lanczos, no covariance matrix formed.

Entries become whole numbers x = floor(64 c) + 1,000,000, so counts, sums and deviations n x - S are exact. The *fit list*, each distinct vector once,
is written once and read by every pass. One pass multiplies the centred list by a block of directions and back (Xᵀ(X V), one
d × b matrix per task, summed along a tree). Each new block is orthogonalised against the whole basis, twice; columns that break down are replaced by random ones orthogonal
to it (a restart), until the basis is the whole space or the residuals |V u - e u| of the wanted components are below ``TOLERANCE`` of the
largest eigenvalue. The products are kept, so residuals and Rayleigh quotients come from true products, not from recurrences. The trace is the sum of squared
deviations, by whole numbers.

Defined cases: vectors that are null, empty, of a length that isn't the commonest, or that hold null, non-finite or too large (2^62 after scaling)
entries take no part; repeated rows count once in the fit and are each returned; components whose eigenvalue is zero
(below ``ZERO`` of the largest: constant dimensions, fewer distinct vectors than components) have no whitened value and are left out, so a table of one
distinct vector, or an empty one, gives an empty result; a deviation beyond a long is null; a component's entry of largest size is positive; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitweave.llm.common import materialise
from remitweave.llm.vectors import matrix, whole

SCALE, OFFSET, COMPONENTS, BLOCK = 64, 1_000_000, 16, 16
#: Residual at which a component has converged, and size of an eigenvalue that counts as zero, both to the largest one.
TOLERANCE, ZERO = 1e-13, 1e-12
#: Norm, to that before, under which an orthogonalised column has broken down.
BREAKDOWN = 1e-10
ROWS, LONG = 4096, (1 << 63) - 1


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, in Python's numbers where 64 bits might not hold it."""
    shift = [s // n for s in sums]  # any whole number near the mean: keeps products small
    rest = [s - n * m for s, m in zip(sums, shift, strict=True)]
    y = x.astype(object) - np.array(shift, object) if max(map(abs, shift)) >= 1 << 61 else x - np.array(shift, np.int64)
    if y.dtype != object and n * (int(np.abs(y).max(initial=0)) + 1) >= 1 << 62:
        y = y.astype(object)
    return y * n - np.array(rest, y.dtype)


def squares(dev: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    if dev.dtype != object and int(np.abs(dev).max(initial=0)) ** 2 * dev.shape[1] >= 1 << 63:
        dev = dev.astype(object)
    return (dev * dev).sum(1).tolist()


def new_block(basis: np.ndarray, block: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns orthogonal to ``basis``: those of ``block``, and random ones where they break down, as far as the space goes."""
    out = np.zeros((len(block), 0))
    for column in block.T:
        for _ in range(4):
            have = np.hstack([basis, out])
            if have.shape[1] == len(block):
                return out
            size = np.linalg.norm(column)
            for _ in range(2):
                column = column - have @ (have.T @ column)
            left = np.linalg.norm(column)
            if left > BREAKDOWN * size:
                column = column / left
                column = column - have @ (have.T @ column)
                out = np.hstack([out, (column / np.linalg.norm(column))[:, None]])
                break
            column = rng.standard_normal(len(block))
    return out


def lanczos(times, dim: int, wanted: int, block: int = BLOCK, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors (columns). ``times``: V times a block of columns."""
    rng = np.random.default_rng(seed)
    basis = new_block(np.zeros((dim, 0)), rng.standard_normal((dim, min(block, dim))), rng)
    products = times(basis)
    while True:
        t = basis.T @ products
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1][:wanted], turn[:, ::-1][:, :wanted]
        vectors = basis @ turn
        missed = np.linalg.norm(products @ turn - vectors * values, axis=0)
        if basis.shape[1] == dim or len(values) == wanted and missed.max() <= TOLERANCE * max(values[0], 0.0):
            return values, vectors
        fresh = new_block(basis, products[:, -block:], rng)
        basis, products = np.hstack([basis, fresh]), np.hstack([products, times(fresh)])


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows, dim = whole(vectors, SCALE, OFFSET, F.col(id_col).alias("id"), vector_col=vector_col)
    if not dim:
        return spark.createDataFrame([], schema)
    fit = materialise(rows.select("x").distinct())

    def reduced(of) -> np.ndarray:
        """Sum over tasks of ``of`` each batch of the fit list, in a tree; entries may be whole numbers of any size."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pickle

            total = None
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = of(matrix(b.column(0).slice(at, ROWS), dim))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

        def opened(row) -> np.ndarray:
            import pickle

            return pickle.loads(row["part"])

        parts = fit.mapInArrow(run, "part binary").rdd.map(opened)
        return parts.treeReduce(lambda a, b: a + b, depth=2 if parts.getNumPartitions() < 4096 else 3)

    def counts(x: np.ndarray) -> np.ndarray:
        small = len(x) * int(np.abs(x).max()) < 1 << 63
        return np.array([len(x), *(x if small else x.astype(object)).sum(0).tolist()], object)

    counted = reduced(counts)
    n, sums = int(counted[0]), [int(s) for s in counted[1:]]
    trace = int(reduced(lambda x: np.array([sum(squares(deviations(x, n, sums)))], object))[0]) / n**3
    if trace == 0:
        return spark.createDataFrame([], schema)

    def centred(x: np.ndarray) -> np.ndarray:
        return deviations(x, n, sums).astype(np.float64) / n

    def times(block: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(block)

        def of(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return y.T @ (y @ shared.value)

        return reduced(of) / n

    values, found = lanczos(times, dim, min(components, dim))
    real = values > ZERO * values[0]
    values, found = values[real], found[:, real]
    found = found * np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])
    model = sc.broadcast(found / np.sqrt(values))

    def spread(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ model.value
        return w.T @ w

    error = float(np.abs(reduced(spread) / n - np.eye(len(values))).max())
    shares = values / trace

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shares)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                b = whole_batch.slice(at, ROWS)
                dev = deviations(matrix(b.column(1), dim), n, sums)
                w = (dev.astype(np.float64) / n) @ model.value
                each = pa.array(np.repeat(np.arange(b.num_rows), k))
                size = pa.array([d if d <= LONG else None for d in squares(dev)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(each),
                        pa.array(np.tile(np.arange(1, k + 1), b.num_rows), pa.int32()),
                        pa.array(np.full(len(each), n), pa.int64()),
                        size.take(each),
                        pa.array(w.ravel()),
                        pa.array(np.tile(shares, b.num_rows)),
                        pa.array(np.full(len(each), error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("id", "x").mapInArrow(projected, schema)

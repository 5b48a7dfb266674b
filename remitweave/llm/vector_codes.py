"""Product codes of vectors: four codebooks of whole-number entries, learned and applied exactly.

Vectors become whole numbers, floor(1024 x), and are written once as *part blocks*: up to ``BLOCK`` rows a block, column after
column, in the narrowest integers that hold them. Each round is one ``treeAggregate`` over the blocks: within a block, squared distances to
all entries of a codebook accumulate dimension by dimension, ``np.add.at`` sums the parts of each entry into int64 tensors, and
the tensors (as large as the codebooks, whatever the rows) merge through a reduction tree, so the driver sees one for each branch of its top.
A lost executor costs a reading of its blocks. Sums of whole numbers don't depend on the order, so neither do the codes.

Defined cases: vectors that are null, empty, of a length that isn't the commonest, or that hold null, non-finite or too large
(2^62 after scaling) entries take no part; a length that four doesn't divide is cut at i * length // 4; the first entries are those of the smallest (id, vector),
null ids last, repeated rows counted; fewer rows than entries make a smaller codebook; ties go to the lower index; entries without parts stay;
an empty table gives an empty result; null labels are one label; an error beyond a long is null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitweave.llm.common import materialise
from remitweave.llm.vectors import matrix, whole

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of a block, and of a slice whose distances to all entries are held at once.
BLOCK, SLICE = 8192, 1024
#: Labels up to which their sums are broadcast (some 30 bytes each); beyond, the join is shuffled, each label in ``SALTS`` shares.
FEW_LABELS, SALTS = 100_000, 16
LONG = (1 << 63) - 1


def bounds(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(i * dim // parts, (i + 1) * dim // parts) for i in range(parts)]


def width(top: int, dim: int) -> type:
    """Numbers in which a squared distance of entries up to ``top`` can't overflow; Python's own if 64 bits don't do."""
    most = dim * (2 * top) ** 2
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower of equals) and its squared distance. ``columns``: (dim, rows); ``book``: (entries, dim)."""
    n = columns.shape[1]
    near, far = np.zeros(n, np.int64), np.zeros(n, columns.dtype)
    for at in range(0, n, SLICE):
        part = columns[:, at : at + SLICE]
        total = np.zeros((part.shape[1], len(book)), columns.dtype)
        for column, entry in zip(part, book.T, strict=True):
            step = column[:, None] - entry[None, :]
            step *= step
            total += step
        best = total.argmin(1)
        near[at : at + SLICE], far[at : at + SLICE] = best, total[np.arange(len(best)), best]
    return near, far


def unpacked(data: bytes, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(dim, -1)


def tallied(books: list[np.ndarray], columns: np.ndarray, dim: int, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part, the sums (entries, part's dimensions) and counts of what is nearest to each entry."""
    sums = object if kind is object else np.int64
    out = []
    for (a, b), book in zip(bounds(dim), books, strict=True):
        part = columns[a:b].astype(kind)
        near, _ = nearest(part, book.astype(kind))
        total, count = np.zeros(book.shape, sums), np.zeros(len(book), np.int64)
        np.add.at(total, near, part.T.astype(sums))
        np.add.at(count, near, 1)
        out.append((total, count))
    return out


def merged(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return a if b is None else b
    return [(s + t, m + n) for (s, m), (t, n) in zip(a, b, strict=True)]


def moved(book: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = book.copy()
    used = count > 0
    out[used] = total[used] // count[used][:, None]
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, *, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """Per vector: id, label, code, error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    ids, labels = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    rows, dim = whole(vectors, SCALE, 0, F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector_col=vector_col)
    schema = f"id {ids}, label {labels}, code string, error bigint, label_error bigint, codebooks_sha256 string"
    top = rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("top")).first()["top"]
    if top is None:
        return spark.createDataFrame([], schema)
    first = [r["x"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    kind = width(top, dim)
    stored = next(t for t in ("<i2", "<i4", "<i8") if top < 1 << (8 * int(t[2]) - 1))

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                data = np.ascontiguousarray(matrix(b.column(2), dim).T.astype(stored)).tobytes()
                lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([data], pa.binary())], ["ids", "labels", "data"])

    blocks = materialise(rows.select("id", "label", "x").mapInArrow(blocked, f"ids array<{ids}>, labels array<{labels}>, data binary"))
    books = [np.array([x[a:b] for x in first], dtype=object if kind is object else np.int64).reshape(len(first), b - a) for a, b in bounds(dim)]
    data = blocks.select("data").rdd.map(lambda r: bytes(r["data"]))
    depth = max(2, math.ceil(math.log(max(2, data.getNumPartitions()), 32)))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        sums = data.treeAggregate(None, lambda a, d, s=shared: merged(a, tallied(s.value, unpacked(d, stored, dim), dim, kind)), merged, depth)
        books = [moved(book, *x) for book, x in zip(books, sums, strict=True)]
        shared.unpersist()
    final = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, label, packed in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                columns = unpacked(packed, stored, dim)
                found = [nearest(columns[x:y].astype(kind), book.astype(kind)) for (x, y), book in zip(bounds(dim), final.value, strict=True)]
                code = np.stack([near for near, _ in found], 1).astype(">u1" if entries <= 256 else ">u2")
                error = sum(far.astype(object if kind is object else np.int64) for _, far in found)
                yield pa.RecordBatch.from_arrays(
                    [own.values, label.values, pa.array([c.tobytes().hex() for c in code]), pa.array([int(e) if e <= LONG else None for e in error], pa.int64())],
                    ["id", "label", "code", "error"],
                )

    found = materialise(blocks.mapInArrow(coded, f"id {ids}, label {labels}, code string, error bigint"))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = found.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), total).alias("total"))
    sums = materialise(sums.select(F.col("label").alias("of"), F.expr("try_cast(total AS bigint)").alias("label_error")))
    if sums.count() <= FEW_LABELS:
        joined = found.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")), "left")
    else:
        salted = sums.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = found.withColumn("part", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")).join(
            salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("part") == F.col("share")), "left"
        )
    return joined.select("id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

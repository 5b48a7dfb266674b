"""Vectors as whole numbers: which rows take part, and Arrow lists as NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries whose whole number lies beyond this can't be held in a long with room for an offset; their vectors take no part.
TOP = float(1 << 62)


def usable(v: Column, scale: int) -> Column:
    """No null, no non-finite entry, and floor(scale * entry) fits; false for a null or empty vector."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * scale >= TOP))
    return F.coalesce(~bad & (F.size(v) > 0), F.lit(False))


def whole(vectors: DataFrame, scale: int, offset: int, *keep: Column, vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """Rows whose vector takes part, with ``keep`` and ``x`` = floor(scale * entry) + offset, and their length: the commonest
    one, the smaller of two equally common (0: no row). Vectors of another length take no part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(*keep, v.alias("x")).filter(usable(F.col("x"), scale))
    shape = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = shape["d"] if shape else 0
    exact = F.transform("x", lambda c: F.floor(c * scale).cast("bigint") + F.lit(offset).cast("bigint"))
    return rows.filter(F.size("x") == dim).withColumn("x", exact), dim


def matrix(column: pa.Array, dim: int, kind: type = np.int64) -> np.ndarray:
    """An Arrow list column of equal lengths, without nulls, as (rows, dim)."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(kind, copy=False)

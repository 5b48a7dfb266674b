"""Approximate nearest neighbours by inner product: probed lists, scanned with adaptively many dimensions.

* Vectors x become (x, sqrt(M^2 - |x|^2)) with M the largest norm, so that the largest inner product is the
  smallest distance, and are turned by one random rotation, after which any few dimensions are a fair
  sample of a distance.
* Equal vectors are one *class*, which carries its k + 1 smallest ids: enough for any result.
* Lists: the nearest of the centroids that k-means finds on a bounded sample of classes (``SAMPLE``).
  Every class is in a list. A query probes its nearest lists.
* Within a list, candidates are read in column blocks. After each block a hypothesis test on the partial
  distance abandons candidates that are very unlikely to be among the k + 1 nearest so far. Survivors are
  ranked by the inner product of the original vectors in double precision.

Lists are scanned in groups of at most ``ROWS`` candidates and ``QUERIES`` queries, so that a list of any size is
shared among tasks.

Defined cases: vectors that are null, empty, zero, of a length that isn't the commonest, or that hold null or non-finite
components take no part, as query or as candidate; repeated rows of one id and vector are one candidate;
with fewer than k candidates a query returns all; ties go to the smaller id; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitweave.llm.common import materialise

#: Classes that k-means sees at most.
SAMPLE = 20_000
#: Lists at most; beyond about a million classes lists grow instead, and are scanned in groups.
LISTS = 1024
#: Candidates and queries of a scan group at most.
ROWS, QUERIES = 8192, 8192
#: Columns of a block, and the test's width: larger abandons less.
BLOCK, EPSILON = 16, 2.1
#: Candidates of a list that every query measures in full, to have a distance to test against.
SEEDS = 64


def finite(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def augmented(x: np.ndarray, top: float, turn: np.ndarray) -> np.ndarray:
    """Rotated vectors with the component that makes all norms ``top``."""
    rest = np.sqrt(np.maximum(top * top - (x * x).sum(1), 0.0))
    return (np.column_stack([x, rest]) @ turn).astype(np.float32)


def as_queries(q: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Scaled to length 1: an order by inner product doesn't change."""
    unit = q / np.sqrt((q * q).sum(1))[:, None]
    return (np.column_stack([unit, np.zeros(len(q))]) @ turn).astype(np.float32)


def k_means(x: np.ndarray, n: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest_lists(x, centres, 1)[:, 0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def nearest_lists(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    out = []
    norms = (centres * centres).sum(1)
    for at in range(0, len(x), 1024):
        d = norms - 2 * (x[at : at + 1024] @ centres.T)
        out.append(d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), int)


def adaptive_scan(q: np.ndarray, rows: np.ndarray, want: int) -> np.ndarray:
    """Indexes of rows that may be among the ``want`` nearest of q. Both rotated."""
    dim = rows.shape[1]
    seeds = min(len(rows), max(SEEDS, want))
    near = ((rows[:seeds] - q) ** 2).sum(1)
    found, dist = np.arange(seeds), near
    for at in range(seeds, len(rows), 1024):
        if len(dist) > want:
            keep = np.argpartition(dist, want - 1)[:want]
            found, dist = found[keep], dist[keep]
        limit = dist.max()
        alive = np.arange(at, min(at + 1024, len(rows)))
        part = np.zeros(len(alive), np.float32)
        for b in range(0, dim, BLOCK):
            e = min(b + BLOCK, dim)
            part = part + ((rows[alive, b:e] - q[b:e]) ** 2).sum(1)
            keep = part * (dim / e) <= limit * (1 + EPSILON / math.sqrt(e)) ** 2 if e < dim else part <= limit * 1.00001
            alive, part = alive[keep], part[keep]
            if not len(alive):
                break
        found, dist = np.concatenate([found, alive]), np.concatenate([dist, part])
    if len(dist) > want:
        found = found[np.argpartition(dist, want - 1)[:want]]
    return found


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    probe_share: float = 0.65,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Per query and rank: query_id, rank (from 1), id, score (inner product), nearest first.

    ``is_query``: condition on the columns of ``vectors``. A query probes ``probe_share`` of the lists, and on until their lists hold 4 k candidates.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, rank int, id {kind}, score double"
    rows = (
        vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
        .filter(finite(F.col("v")) & F.col("id").isNotNull())
    )
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shapes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("top"))
    shape = shapes.orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], schema)
    dim, top = shape["dim"], math.sqrt(shape["top"])
    rows = rows.filter(F.size("v") == dim)

    by_vector = Window.partitionBy("v").orderBy("id")
    classes = materialise(
        rows.withColumn("_place", F.dense_rank().over(by_vector))
        .filter(F.col("_place") <= k + 1)
        .groupBy("v")
        .agg(F.array_sort(F.collect_set("id")).alias("members"))
        .withColumn("cls", F.concat_ws(":", F.col("members")[0].cast("string"), F.hex(F.xxhash64("v"))))
    )
    asked = materialise(rows.filter("q").select("id", "v").distinct().join(classes.select("v", "cls"), "v").select("id", "cls"))

    n_classes = classes.count()
    n_lists = max(1, min(LISTS, round(math.sqrt(n_classes))))
    sample = classes.select("v").orderBy(F.xxhash64("v")).limit(min(SAMPLE, 64 * n_lists)).toPandas()
    turn = rotation(dim + 1, seed)
    centres = k_means(augmented(np.stack(sample["v"].to_numpy()), top, turn), n_lists, seed)
    model = spark.sparkContext.broadcast((top, turn, centres))

    def vectors_of(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, r, c = model.value
        for b in batches:
            x = vectors_of(b.column(2))
            own = nearest_lists(augmented(x, m, r), c, 1)[:, 0]
            raw = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw, pa.array(own, pa.int32())], ["cls", "first", "raw", "list"])

    index = materialise(
        classes.select("cls", F.col("members")[0].alias("first"), "v").mapInArrow(listed, f"cls string, first {kind}, raw binary, list int")
    )
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = np.array([sizes.get(i, 0) for i in range(len(centres))])
    n_probe = math.ceil(probe_share * len(centres))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, r, c = model.value
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(b.num_rows, dim)
            order = nearest_lists(as_queries(x, r) * top, c, len(c))
            enough = (np.cumsum(held[order], axis=1) < 4 * (k + 1)).sum(1) + 1
            counts = np.minimum(np.maximum(n_probe, enough), len(c))
            take = np.repeat(np.arange(b.num_rows), counts)
            lists = np.concatenate([o[:n] for o, n in zip(order, counts, strict=True)]) if b.num_rows else np.zeros(0)
            t = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(t), b.column(1).take(t), pa.array(lists, pa.int32())], ["cls", "raw", "list"])

    wanted = asked.select("cls").distinct().join(index.select("cls", "raw"), "cls")
    probes = materialise(wanted.mapInArrow(probed, "cls string, raw binary, list int"))
    load = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not load:
        return spark.createDataFrame([], schema)
    # blocks of each list, by list number: as many numbers as there are lists
    n_rows = F.array(*[F.lit(-(-sizes.get(i, 0) // ROWS)) for i in range(len(centres))])[F.col("list")]
    n_asked = F.array(*[F.lit(-(-load.get(i, 0) // QUERIES)) for i in range(len(centres))])[F.col("list")]
    left = (
        index.withColumn("i", F.pmod(F.xxhash64("cls"), n_rows).cast("int"))
        .withColumn("_n", n_asked)
        .filter("_n > 0")
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .drop("_n")
    )
    right = (
        probes.withColumn("j", F.pmod(F.xxhash64("cls"), n_asked).cast("int"))
        .withColumn("_n", n_rows)
        .filter("_n > 0")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .drop("_n")
    )

    def scan(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        m, r, _ = model.value
        cols = ["query", "cls", "first", "score"]
        if rows.empty or queries.empty:
            return pd.DataFrame(columns=cols)
        x = np.frombuffer(b"".join(rows.raw), np.float64).reshape(len(rows), dim)
        qs = np.frombuffer(b"".join(queries.raw), np.float64).reshape(len(queries), dim)
        turned, asked_turned = augmented(x, m, r), as_queries(qs, r) * np.float32(m)
        cls, first, out = rows.cls.to_numpy(), rows["first"].to_numpy(), []
        for name, q, t in zip(queries.cls, qs, asked_turned, strict=True):
            at = adaptive_scan(t, turned, min(len(x), k + 1 + 8))
            score = (x[at] * q).sum(1)
            best = np.lexsort((first[at], -score))[: k + 1]
            out.append((name, at[best], score[best]))
        at = np.concatenate([o[1] for o in out])
        names = np.repeat(np.array([o[0] for o in out], object), [len(o[1]) for o in out])
        return pd.DataFrame({"query": names, "cls": cls[at], "first": first[at], "score": np.concatenate([o[2] for o in out])})

    near = (
        left.groupBy("list", "i", "j")
        .cogroup(right.groupBy("list", "i", "j"))
        .applyInPandas(scan, f"query string, cls string, first {kind}, score double")
    )
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    best = near.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= k + 1)
    # at most k + 1 classes of at most k + 1 ids each to a query
    entries = best.join(classes.select("cls", "members"), "cls").select("query", F.explode("members").alias("id"), "score")
    lists = entries.groupBy("query").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "id", "score"))), 1, k + 1).alias("near")
    )
    return (
        asked.join(lists, asked["cls"] == lists["query"])
        .select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, k).alias("near"))
        .select("query_id", F.posexplode("near").alias("_at", "e"))
        .select("query_id", (F.col("_at") + 1).alias("rank"), F.col("e.id").alias("id"), F.col("e.score").alias("score"))
    )

"""Shared helpers: the shared scratch folder, materialised tables, bounded id filters, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session without
    that setting (tests) gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
            sc.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/remitweave-{uuid.uuid4().hex}"


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a
    lost executor costs no recomputation of what is already written."""
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a worker process remembers between tasks, by the operator that it is for.
_remembered: dict[str, dict] = {}


def remembered(operator: str | None) -> dict:
    """A worker's memory for one operator. Spark reuses workers: what others left there goes."""
    for name in [x for x in _remembered if x != operator]:
        _remembered.pop(name).clear()
    return _remembered.setdefault(operator, {}) if operator else {}


def map_arrow(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table],
    schema: str,
    rows: int = 512,
    memory: str | None = None,
) -> DataFrame:
    """``mapInArrow`` in slices of at most ``rows`` rows, so that a Python worker holds few texts at once.
    ``memory``: the operator whose memory the worker keeps (see ``remembered``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(memory)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    return df.mapInArrow(run, schema)


def id_bits(ids: DataFrame, col: Column, log2_bits: int) -> DataFrame:
    """A one-hash bit filter of ``col`` as rows (word, bits): at most 2**(log2_bits-6) rows,
    whatever the input, which is the proof for broadcasting it."""
    pos = F.pmod(F.xxhash64(col), F.lit(1 << log2_bits))
    return (
        ids.select(F.shiftright(pos, 6).alias("_word"), (pos % 64).cast("int").alias("_bit"))
        .groupBy("_word")
        .agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    )


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def flag_by_bits(df: DataFrame, col: Column, bits: DataFrame, log2_bits: int, name: str) -> DataFrame:
    """``df`` with boolean ``name``, which no column of ``df`` may have: false means that ``col`` is surely not in the filter."""
    pos, word, held = (fresh(df, x) for x in ("_pos", "_word", "_bits"))
    hit = F.coalesce(F.expr(f"shiftright(`{held}`, cast(`{pos}` % 64 as int)) & 1L"), F.lit(0)) == 1
    return (
        df.withColumn(pos, F.pmod(F.xxhash64(col), F.lit(1 << log2_bits)))
        .withColumn(word, F.shiftright(pos, 6))
        .join(F.broadcast(bits.toDF(word, held)), word, "left")
        .withColumn(name, hit)
        .drop(pos, word, held)
    )

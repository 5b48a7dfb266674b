"""Tables written once to the folder that driver and executors share, for plans that read them several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``. Only a local session without that setting (tests) gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
            sc.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/remitweave-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table: what follows scans the columns that it needs, and a lost executor repeats none of what came before."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, anew: bool = False) -> DataFrame:
    """``df`` over as many tasks as shuffles have, before dear work in Python: by size alone a table of few, narrow rows would be left to one. What follows may group by
    ``keys`` without a further shuffle. ``anew``: rows that already lie by their keys are dealt again, by a hash of these."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*keys)) if anew else df.repartition(n, *keys)

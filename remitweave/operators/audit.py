"""Decision log: hash chain, verification, history, four eyes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def body(batch: str = "batch_id", seq: str = "seq", agent: str = "agent", detail: str = "detail") -> Column:
    """The text that an entry's hash covers, after the hash before it."""
    return F.concat_ws("|", F.col(batch), F.col(seq).cast("string"), F.col(agent), F.col(detail))


def sealed(entries: DataFrame) -> DataFrame:
    """Entries (batch_id, seq, agent, detail) with prev_hash and hash. A chain is sequential by nature, batches are independent: each
    batch's entries stream in order through one task, which holds one record batch and the hash before it."""
    kept = entries.select("batch_id", "seq", "agent", "detail")
    order = kept.select("*", F.to_json(F.struct("batch_id")).alias("_chain"), body().alias("_body")).repartition("_chain").sortWithinPartitions("_chain", "seq", "agent", "detail")

    names = kept.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = None, GENESIS
        for batch in batches:
            before, own = [], []
            for name, text in zip(batch.column("_chain").to_pylist(), batch.column("_body").to_pylist(), strict=True):
                if name != chain:
                    chain, last = name, GENESIS
                before.append(last)
                last = hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(before, pa.string()), pa.array(own, pa.string())], [*names, "prev_hash", "hash"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return order.mapInArrow(fold, f"{kind}, prev_hash string, hash string")


def verify(chain: DataFrame) -> DataFrame:
    """Per batch: entries, whether each follows from the one before, the first that doesn't, the receipt (last hash)."""
    order = Window.partitionBy("batch_id").orderBy("seq")
    good = (F.col("prev_hash") == F.coalesce(F.lag("hash").over(order), F.lit(GENESIS))) & (F.col("hash") == F.sha2(F.concat_ws("|", F.col("prev_hash"), body()), 256))
    return (
        chain.withColumn("good", good)
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("good").alias("intact"), F.min(F.when(~F.col("good"), F.col("seq"))).alias("first_break"), F.max_by("hash", "seq").alias("receipt"))
    )


def find(entries: DataFrame, agent: str, text: str, limit: int) -> DataFrame:
    return entries.filter((F.col("agent") == agent) & F.contains(F.lower("detail"), F.lit(text.lower()))).orderBy(F.desc("seq"), "batch_id").limit(limit)


def actor(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def marker(who: Column, act: Column) -> Column:
    """The tail of a log line that says who did what."""
    return F.concat(F.lit(" [sod actor="), actor(who), F.lit("|act="), act, F.lit("]"))


def conflicts(approvals: DataFrame, makers: DataFrame) -> DataFrame:
    """Approvals by someone who made an earlier decision on the same batch."""
    made = makers.select("batch_id", actor(F.col("actor")).alias("who")).distinct()
    return approvals.withColumn("who", actor(F.col("actor"))).join(made, ["batch_id", "who"], "left_semi").drop("who")


def newest(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc("at"), "batch_id").limit(limit)

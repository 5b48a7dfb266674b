"""Notifications as a state table: what was announced and isn't reconciled yet.

The table is a folder of changes, one folder per batch that overwrites itself when it is repeated: an announcement (``kind`` 0) or a settlement marked as reconciled (``kind`` 1).
A settlement's state is its latest announcement, and whether a mark follows it, so any order of reading and any number of replays give the same state. ``compact`` rewrites
the changes as one announcement and one mark for each settlement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Events that announce a settlement.
EVENTS = ("settlement.processed", "settlement.failed")
CHANGES = "settlement_id string, kind int, at timestamp, event_id string, event string, amount_cents bigint, currency string"


def announcements(delivered: DataFrame) -> DataFrame:
    """Verified deliveries (event_id, event, settlement_id, amount_cents, currency, received) as changes; other events and those without a settlement are left out."""
    good = delivered.filter(F.col("event").isin(*EVENTS) & (F.coalesce(F.trim("settlement_id"), F.lit("")) != ""))
    return good.select(
        F.trim("settlement_id").alias("settlement_id"), F.lit(0).alias("kind"), F.col("received").alias("at"), "event_id", "event", F.coalesce("amount_cents", F.lit(0)).cast("bigint").alias("amount_cents"),
        F.upper(F.coalesce("currency", F.lit("INR"))).alias("currency"),
    )


def marks(reconciled: DataFrame) -> DataFrame:
    """reconciled: settlement_id, at. A mark holds for what was announced up to then."""
    none = F.lit(None)
    return reconciled.select("settlement_id", F.lit(1).alias("kind"), "at", none.cast("string").alias("event_id"), none.cast("string").alias("event"), none.cast("bigint").alias("amount_cents"), none.cast("string").alias("currency"))


def state(changes: DataFrame) -> DataFrame:
    """One row per announced settlement: its latest announcement (of equal times the greatest event_id), and whether a mark came at that time or later."""
    row = F.struct("at", "event_id", "event", "amount_cents", "currency")
    each = changes.groupBy("settlement_id").agg(F.max(F.when(F.col("kind") == 0, row)).alias("a"), F.max(F.when(F.col("kind") == 1, F.col("at"))).alias("marked"))
    return each.filter("a IS NOT NULL").select(
        "settlement_id", "a.event_id", "a.event", "a.amount_cents", "a.currency", F.col("a.at").alias("received"), F.coalesce(F.col("marked") >= F.col("a.at"), F.lit(False)).alias("reconciled")
    )


def pending(changes: DataFrame) -> DataFrame:
    """What isn't reconciled, oldest first."""
    return state(changes).filter(~F.col("reconciled")).drop("reconciled").orderBy("received", "settlement_id")


def follow(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of changes into the table below ``path``."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mark(spark: SparkSession, reconciled: DataFrame, path: str, run: str) -> None:
    """Marks the settlements of a finished run; a repeated run overwrites its own marks."""
    marks(reconciled).write.mode("overwrite").parquet(f"{path}/batch=run-{run}")


def changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGES).parquet(path).select(*[c.split()[0] for c in CHANGES.split(", ")])


def compact(table: DataFrame) -> DataFrame:
    """The same state in at most two changes for each settlement, to be written as a new table."""
    now = state(table)
    kept = now.select("settlement_id", F.lit(0).alias("kind"), F.col("received").alias("at"), "event_id", "event", "amount_cents", "currency")
    last = table.filter("kind = 1").groupBy("settlement_id").agg(F.max("at").alias("at"))
    return kept.unionByName(marks(last))

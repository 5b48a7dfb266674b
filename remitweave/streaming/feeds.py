"""Continuous feeds with Structured Streaming: signed notifications, claims, payout lags."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType

from remitweave.operators.learning import lag_level

NOTIFICATIONS = "event_id string, settlement_id string, amount_cents long, body string, signature string, received timestamp"


def signature_valid(key: str):
    """Whether an HMAC-SHA256 signature is that of the body."""

    @F.pandas_udf(BooleanType())
    def check(body: pd.Series, given: pd.Series) -> pd.Series:
        own = [hmac.new(key.encode(), (b or "").encode(), hashlib.sha256).hexdigest() for b in body]
        return pd.Series([hmac.compare_digest(a, g or "") for a, g in zip(own, given, strict=True)])

    return check


def notifications(source: DataFrame, key: str, remember: str = "48 hours") -> DataFrame:
    """Signed notifications, each event once within ``remember``; for a stream or a table."""
    good = source.filter(signature_valid(key)("body", "signature"))
    if source.isStreaming:
        return good.withWatermark("received", remember).dropDuplicatesWithinWatermark(["event_id"])
    return good.dropDuplicates(["event_id"])


def read_notifications(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(NOTIFICATIONS).json(path)


def record_claims(claims: DataFrame, path: str, checkpoint: str):
    """Keep the ledger of consumed payments (txn_key, owner) below ``path``, first writer wins: the stream's state holds each
    payment's owner, so that a batch costs its own payments only, however long the ledger (with the RocksDB state store, on disk).
    A batch adds its own folder, named by its number, so that a repeated batch overwrites itself."""

    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        best = None
        for pdf in frames:
            both = pdf if best is None else pd.concat([best, pdf])
            best = both.sort_values(["at", "settlement_id"], na_position="first").head(1)
        owner = best["settlement_id"].iloc[0]
        state.update((owner,))
        yield pd.DataFrame({"txn_key": [key[0]], "owner": [owner]})

    owners = claims.groupBy("txn_key").applyInPandasWithState(first, "txn_key string, owner string", "owner string", "append", GroupStateTimeout.NoTimeout)

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return owners.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lag_counts(members: DataFrame) -> DataFrame:
    """Running payout-lag histogram by merchant and feed, from a stream of (merchant, source, settled, captured, event_id) rows."""
    once = members.withWatermark("settled", "2 days").dropDuplicatesWithinWatermark(["event_id"]) if members.isStreaming else members.dropDuplicates(["event_id"])
    lag = F.datediff("settled", "captured")
    return once.groupBy("merchant", "source", lag_level(lag).alias("level")).count()


def hourly(events: DataFrame) -> DataFrame:
    """Events and value by hour and type, late rows up to an hour."""
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value_cents").alias("value_cents"))

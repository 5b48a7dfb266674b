"""What cleared settlements teach: payout lags, confidence calibration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lag levels, smoothing, settlements before a profile counts, entropy gain for working days.
LEVELS = ("0", "1", "2", "3", "4-7", "other")
SMOOTHING, LEAST_SETTLEMENTS, SHARPER = 0.5, 3, 0.05
BANDS = (0.0, 0.5, 0.7, 0.85, 0.95)


def latest_outcomes(outcomes: DataFrame) -> DataFrame:
    """The reviewers' last word on each batch (batch_id, confidence, confirmed, reviewer, at); of equal times the greatest row."""
    last = F.max_by(F.struct("confidence", "confirmed", "reviewer"), F.struct("at", "reviewer", "confidence", "confirmed"))
    return outcomes.groupBy("batch_id").agg(last.alias("o")).select("batch_id", "o.*")


def lag_level(days: Column) -> Column:
    return F.when(days.between(0, 3), days.cast("string")).when(days.between(4, 7), "4-7").otherwise("other")


def lag_histogram(members: DataFrame, keys: list[str], lag: str) -> DataFrame:
    """Payments by lag level for each key, from distinct (settlement_id, payment) rows, smoothed to probabilities."""
    spark = members.sparkSession
    counted = members.groupBy(*keys, lag_level(F.col(lag)).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    levels = F.broadcast(spark.createDataFrame([(x,) for x in LEVELS], "level string"))
    enough = members.groupBy(*keys).agg(F.countDistinct("settlement_id").alias("settlements")).filter(F.col("settlements") >= LEAST_SETTLEMENTS)
    full = enough.join(levels).join(counted, [*keys, "level"], "left").fillna(0, ["n"])  # six levels for each key
    total = F.sum("n").over(Window.partitionBy(*keys))
    return full.withColumn("p", F.round((F.col("n") + SMOOTHING) / (total + SMOOTHING * len(LEVELS)), 9))


def entropy(histogram: DataFrame, keys: list[str]) -> DataFrame:
    return histogram.groupBy(*keys).agg(F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("entropy"))


def sharper(calendar: DataFrame, working: DataFrame, keys: list[str]) -> DataFrame:
    """The unit in which lags are more regular: working days only if clearly so."""
    both = entropy(calendar, keys).withColumnRenamed("entropy", "c").join(entropy(working, keys).withColumnRenamed("entropy", "w"), keys)
    return both.select(*keys, F.when(F.col("w") < F.col("c") - SHARPER, "working").otherwise("calendar").alias("unit"))


def band_of(confidence: Column) -> Column:
    out = F.lit(0)
    for k, low in enumerate(BANDS):
        out = F.when(confidence >= low, k).otherwise(out)
    return out


def expected_calibration_error(pairs: DataFrame) -> DataFrame:
    """pairs: confidence, right (0/1)."""
    bands = pairs.groupBy(band_of(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg("right").alias("r"))
    return bands.agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("r"))) / F.sum("n"), 6).alias("ece"))


def reviewer_drift(pairs: DataFrame, gap: float = 0.15, least: int = 20) -> DataFrame:
    """Bands in which reviewers agree clearly less or more often than the confidence says."""
    bands = pairs.groupBy(band_of(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("stated"), F.round(F.avg("right"), 6).alias("agreed"))
    return bands.filter((F.col("n") >= least) & (F.abs(F.col("stated") - F.col("agreed")) > gap))


def isotonic(pairs: DataFrame, by: str) -> DataFrame:
    """Monotone map from confidence to smoothed accuracy (x, y) per group: ties pooled first, so that a group brings one row
    for each distinct confidence (six decimals) to its task, a million at most."""
    ties = pairs.groupBy(by, F.round("confidence", 6).alias("x")).agg(F.sum("right").cast("double").alias("r"), F.count(F.lit(1)).cast("double").alias("n"))

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list] = []
        for x, r, n in pdf.sort_values("x")[["x", "r", "n"]].itertuples(index=False):
            blocks.append([[x], r, n])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                xs, r2, n2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + xs, blocks[-1][1] + r2, blocks[-1][2] + n2]
        rows, top = [], 0.0
        for xs, r, n in blocks:
            top = max(top, (r + 1) / (n + 2))
            rows += [(pdf[by].iloc[0], x, top) for x in xs]
        return pd.DataFrame(rows, columns=[by, "x", "y"])

    return ties.groupBy(by).applyInPandas(pool, f"{by} {pairs.schema[by].dataType.simpleString()}, x double, y double")


def interpolate(confidence: Column, points: list[tuple[float, float]], gate: float = 0.85) -> Column:
    """Piecewise linear, flat ends; below the gate never above the raw confidence."""
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(confidence < x1, y0 + (confidence - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    out = F.when(confidence <= points[0][0], points[0][1]).otherwise(out)
    return F.when(confidence < gate, F.least(out, confidence)).otherwise(out)

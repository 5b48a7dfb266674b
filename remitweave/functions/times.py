"""Timestamps, day order and Indian banking days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Zone of feeds that state none; national holidays (month, day).
SOURCE_ZONES = {"gateway": "UTC", "bank": "Asia/Kolkata", "erp": "Asia/Kolkata"}
NATIONAL_HOLIDAYS = ((1, 26), (8, 15), (10, 2))
OFFSET = r"(Z|z|[+-]\d{2}:?\d{2})$"


def zone_confidence(raw: Column, source: Column, read: Column | None = None) -> Column:
    """HIGH with an offset, INFERRED by the feed's zone, LOW without either; null if unreadable. ``read``: its ``utc``, if that is a column already."""
    return F.when((utc(raw, source) if read is None else read).isNull(), None).when(raw.rlike(OFFSET), "HIGH").when(source.isin(*SOURCE_ZONES), "INFERRED").otherwise("LOW")


def utc(raw: Column, source: Column) -> Column:
    """ISO-8601 text as a UTC timestamp (session zone UTC), null if unreadable."""
    text = F.trim(raw)
    local = F.try_to_timestamp(F.regexp_replace(text, OFFSET, ""))
    zoned = F.try_to_timestamp(text)
    zone = F.lit("UTC")
    for name, of_feed in SOURCE_ZONES.items():
        zone = F.when(source == name, of_feed).otherwise(zone)
    return F.when(text.rlike(OFFSET), zoned).otherwise(F.to_utc_timestamp(local, zone))


def day_order(dates: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Per group, whether d/m/y values start with the day or the month, and whether a value proves it."""
    first, second = (F.regexp_extract(column, r"^(\d{1,2})[/.-](\d{1,2})[/.-]", k).try_cast("int") for k in (1, 2))
    proof = dates.groupBy(*by).agg(F.max(first).alias("a"), F.max(second).alias("b"))
    day, month = F.col("a") > 12, F.col("b") > 12
    return proof.select(*by, F.when(month & ~day, "month").otherwise("day").alias("day_order"), (day != month).alias("proven"))


def parse_day(value: Column, order: Column) -> Column:
    """d/m/y or m/d/y text as a date; two-digit years below 70 are in this century."""
    part = [F.regexp_extract(value, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2}|\d{4})$", k).try_cast("int") for k in (1, 2, 3)]
    year = F.when(part[2] < 70, part[2] + 2000).when(part[2] < 100, part[2] + 1900).otherwise(part[2])
    day, month = F.when(order == "day", part[0]).otherwise(part[1]), F.when(order == "day", part[1]).otherwise(part[0])
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def ist_date(ts_seconds: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(ts_seconds), "Asia/Kolkata"))


def closed_because(day: Column) -> Column:
    """Why banks are closed; null on a working day."""
    nth = F.floor((F.dayofmonth(day) - 1) / 7) + 1
    out = F.when(F.weekday(day) == 6, "Sunday").when((F.weekday(day) == 5) & (nth == 2), "second Saturday").when((F.weekday(day) == 5) & (nth == 4), "fourth Saturday")
    for month, dom in NATIONAL_HOLIDAYS:
        out = out.when((F.month(day) == month) & (F.dayofmonth(day) == dom), "national holiday")
    return out


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per day: day, closed, is_working, cum (working days up to and including it)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    rows = days.withColumn("closed", closed_because(F.col("day"))).withColumn("is_working", F.col("closed").isNull())
    return rows.withColumn("cum", F.sum(F.col("is_working").cast("bigint")).over(Window.orderBy("day")))  # a row for each day of the range


def add_working_days(rows: DataFrame, day: str, n: int, dim: DataFrame, name: str) -> DataFrame:
    """The n-th working day after ``day``, which itself doesn't count; null for a day outside ``dim``: calendar(), a few thousand days."""
    start = dim.select(F.col("day").alias(day), F.col("cum").alias("_cum"))
    due = dim.filter("is_working").select(F.col("cum").alias("_target"), F.col("day").alias(name))
    return rows.join(F.broadcast(start), day, "left").join(F.broadcast(due), F.col("_cum") + n == F.col("_target"), "left").drop("_cum", "_target")


def working_days_between(rows: DataFrame, start: str, end: str, dim: DataFrame, name: str) -> DataFrame:
    """Working days in (start, end]; 0 if end is not after start, null if either day is outside ``dim``."""
    a = F.broadcast(dim.select(F.col("day").alias(start), F.col("cum").alias("_a")))
    b = F.broadcast(dim.select(F.col("day").alias(end), F.col("cum").alias("_b")))
    return rows.join(a, start, "left").join(b, end, "left").withColumn(name, F.when(F.col("_b") >= F.col("_a"), F.col("_b") - F.col("_a")).when(F.col("_b") < F.col("_a"), 0)).drop("_a", "_b")

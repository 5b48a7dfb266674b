"""Foreign payments of a settlement: rates that nobody declared, and declared ones far from the published."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: share of the reference rate from which a declared one is doubtful.
MAX_GAP = 0.03


def undeclared(payments: DataFrame, declared: DataFrame) -> DataFrame:
    """Payments left out for want of a rate, by settlement and currency. payments: settlement_id, home, currency, currency_stated;
    declared: settlement_id, currency. A currency that isn't stated or null is the settlement's own."""
    foreign = payments.filter(F.col("currency_stated") & (F.upper("currency") != F.upper("home"))).select("settlement_id", F.upper("currency").alias("currency"))
    known = declared.select("settlement_id", F.upper("currency").alias("currency"))
    return foreign.join(known, ["settlement_id", "currency"], "left_anti").groupBy("settlement_id", "currency").agg(F.count(F.lit(1)).alias("n"))


def gaps(declared: DataFrame, reference: DataFrame, *, stale: int = 30, most: float = MAX_GAP) -> DataFrame:
    """Declared rates (settlement_id, currency, day, rate) whose gap to the reference (currency, day, rate: published once a day) is
    larger than ``most``. The reference of a day is the last one published by then, at most ``stale`` days before: it is
    carried forward, a row for each day, so that the join is an equality. Without one, or if it is 0, nothing is said."""
    later = F.lead("day").over(Window.partitionBy("currency").orderBy("day"))
    until = F.least(F.date_sub(later, 1), F.date_add("day", stale))
    spans = reference.select("currency", "day", until.alias("until"), F.col("rate").alias("reference"))
    each = spans.select("currency", F.explode(F.sequence("day", "until")).alias("day"), "reference")
    exact = lambda c: F.col(c).cast("decimal(18,8)")
    far = F.abs(exact("rate") - exact("reference")) > F.lit(most).cast("decimal(9,6)") * F.abs(exact("reference"))
    gap = (F.col("rate") - F.col("reference")) / F.col("reference")
    return declared.join(each.filter("reference <> 0"), ["currency", "day"]).filter(far).select("settlement_id", "currency", "rate", "reference", gap.alias("gap"))

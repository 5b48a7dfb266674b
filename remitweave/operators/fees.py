"""Fees, taxes and what to claim back. Rates are in basis points; fees and taxes round half to even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitweave.functions.times import ist_date

#: Rate card by method, tax on fees, tolerance.
CARD = {"card": 200, "upi": 0, "wallet": 200, "international_card": 300}
NETBANKING_FLAT, GST_BPS, TOLERANCE_BPS = 500, 1800, 10
#: Default card of a whole settlement.
DEFAULT_BPS, DEFAULT_FLAT, DEFAULT_TAX_BPS = 200, 0, 100
#: Dated schedules (from, bps).
TDS = (("2020-10-01", 75), ("2021-04-01", 100), ("2024-10-01", 10), ("2026-04-01", 10))
TCS = (("2018-10-01", 100), ("2024-07-10", 50))
#: Other names of the methods.
METHOD_ALIASES = {
    "credit_card": "card", "debit_card": "card", "credit": "card", "debit": "card", "vpa": "upi", "bhim": "upi",
    "net_banking": "netbanking", "nb": "netbanking", "paytm": "wallet", "intl_card": "international_card", "international": "international_card",
}


def bps(amount: Column, rate: Column | int) -> Column:
    """Half to even, in decimals; beyond 64 bits null. It holds ``amount`` once: forms in whole numbers or doubles that need it more often were slower, as fees, taxes
    on them and tolerances nest (sf0.1, ``fee_audit``: 9 to 11 s instead of 5)."""
    return F.bround(amount.cast("decimal(28,0)") * (rate if isinstance(rate, Column) else F.lit(rate)).cast("decimal(5,0)") / F.lit(10000).cast("decimal(5,0)"), 0).try_cast("bigint")


def normal_method(raw: Column) -> Column:
    """The usual name of a method: one lookup, so that the expression holds ``raw`` twice, whatever the number of names."""
    plain = F.lower(F.regexp_replace(F.trim(raw), r"[\s-]+", "_"))
    names = F.create_map(*[F.lit(x) for pair in METHOD_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, plain), plain)


def expected_fee(amount: Column, method: Column) -> Column:
    out = F.when(method == "netbanking", F.lit(NETBANKING_FLAT).cast("bigint"))
    for name, rate in CARD.items():
        out = out.when(method == name, bps(amount, rate))
    return out


def gross_target(net: Column, declared: Column) -> Column:
    """Gross that a net deposit stands for: declared deductions, else the default card turned round."""
    kept = F.lit(10000 - DEFAULT_BPS - DEFAULT_TAX_BPS).cast("decimal(5,0)")
    return F.when(declared.isNotNull(), net + declared).otherwise(F.bround((net + DEFAULT_FLAT).cast("decimal(20,0)") * F.lit(10000).cast("decimal(5,0)") / kept, 0).try_cast("bigint"))


def fee_breakdown(settlements: DataFrame) -> DataFrame:
    """gross target, and how deductions split into fee, tax and rest."""
    gross = gross_target(F.col("net_cents"), F.col("declared_deductions"))
    fee = bps(F.col("gross_cents"), DEFAULT_BPS)
    total = F.col("gross_cents") - F.col("net_cents")
    return (
        settlements.withColumn("gross_cents", gross)
        .withColumn("basis", F.when(F.col("declared_deductions").isNotNull(), "declared").otherwise("estimated"))
        .withColumn("fee_part", F.least(fee, total))
        .withColumn("tax_part", total - F.col("fee_part"))
    )


def per_method(payments: DataFrame) -> DataFrame:
    """Expected fees and tax by method."""
    fee = expected_fee(F.col("amount_cents"), F.col("method"))
    rows = payments.withColumn("_fee", fee).withColumn("_gst", bps(F.col("_fee"), GST_BPS))
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("_fee").alias("expected_fee_cents"), F.sum("_gst").alias("expected_gst_cents"))


def audit(payments: DataFrame, *keep: str) -> DataFrame:
    """Over- and undercharged fees and wrong tax of single payments: txn_id, ``keep``, finding, severity, difference_cents."""
    expected = expected_fee(F.col("amount_cents"), F.col("method"))
    rows = payments.filter("amount_cents > 0 AND fee_cents IS NOT NULL").withColumn("expected", expected).filter("expected IS NOT NULL")
    diff = F.col("fee_cents") - F.col("expected")
    allowed = bps(F.abs("amount_cents"), TOLERANCE_BPS)
    gst = bps(F.col("fee_cents"), GST_BPS)
    on_principal = F.abs(F.col("gst_cents") - bps(F.col("amount_cents"), GST_BPS)) <= 1
    fee_finding = (
        F.when(diff > allowed, F.struct(F.lit("fee_overcharge").alias("finding"), F.when(diff >= F.col("expected"), "HIGH").otherwise("WARNING").alias("severity"), diff.alias("difference_cents")))
        .when(diff < -allowed, F.struct(F.lit("fee_undercharge").alias("finding"), F.lit("INFO").alias("severity"), diff.alias("difference_cents")))
    )
    tax_finding = F.when(
        F.abs(F.col("gst_cents") - gst) > 1,
        F.struct(
            F.when(on_principal, "gst_on_principal").otherwise("gst_mismatch").alias("finding"), F.when(on_principal, "HIGH").otherwise("WARNING").alias("severity"), (F.col("gst_cents") - gst).alias("difference_cents")
        ),
    )
    found = F.filter(F.array(fee_finding, tax_finding), lambda x: x.isNotNull())
    return rows.select("txn_id", *keep, F.explode(found).alias("f")).select("txn_id", *keep, "f.*")


def ranked(audited: DataFrame) -> DataFrame:
    """Findings, the gravest first, then the largest differences."""
    gravity = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return audited.orderBy(gravity, F.desc(F.abs("difference_cents")), "txn_id", "finding")


def summary(audited: DataFrame) -> DataFrame:
    """Counts and differences by finding and severity."""
    return audited.groupBy("finding", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("difference_cents").alias("difference_cents"))


def shortfall(settlements: DataFrame, payments: DataFrame) -> DataFrame:
    """Deductions of a settlement against its payments' own fees and tax."""
    items = payments.groupBy("ok").agg(F.sum(F.col("fee_cents") + F.col("gst_cents")).alias("items_cents"))
    diff = F.col("deducted_cents") - F.col("items_cents")
    return (
        settlements.join(items, "ok")
        .withColumn("difference_cents", diff)
        .filter(F.abs(diff) > 1)
        .select("settlement_id", "difference_cents", F.when(F.abs(diff) > 100, "HIGH").otherwise("WARNING").alias("severity"))
    )


def repeated_fees(payments: DataFrame, key: str) -> DataFrame:
    """The second and later times that a payment's fee is charged, with the count so far."""
    seen = Window.partitionBy(key, "fee_cents").orderBy("ts", "txn_id").rowsBetween(Window.unboundedPreceding, 0)
    return payments.withColumn("times", F.count(F.lit(1)).over(seen)).filter("times > 1").select("txn_id", "times")


def rate_on(day: Column, schedule: tuple[tuple[str, int], ...]) -> Column:
    """As-of lookup in a dated schedule: the last rate in force on ``day``, null before the first."""
    out = F.lit(None).cast("int")
    for start, rate in schedule:
        out = F.when(day >= F.lit(start).cast("date"), rate).otherwise(out)
    return out


def tds(payments: DataFrame, by: str, threshold_cents: int) -> DataFrame:
    """Tax due at source on what exceeds a yearly threshold, which the earliest payments use up."""
    year = F.year(F.add_months(ist_date(F.col("ts")), -3))  # from April to March
    before = F.coalesce(F.sum(F.abs("amount_cents")).over(Window.partitionBy(by, year).orderBy("ts", "txn_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gross = F.abs("amount_cents")
    taxable = F.greatest(F.lit(0), F.least(gross, F.col("before") + gross - threshold_cents))
    return (
        payments.withColumn("before", before)
        .withColumn("rate", rate_on(ist_date(F.col("ts")), TDS))
        .withColumn("taxable_cents", taxable)
        .filter("rate IS NOT NULL AND taxable_cents > 0")
        .withColumn("tds_cents", bps(F.col("taxable_cents"), F.col("rate")))
        .groupBy(by)
        .agg(F.sum("taxable_cents").alias("taxable_cents"), F.sum("tds_cents").alias("tds_cents"))
    )


def tcs(payments: DataFrame, by: str) -> DataFrame:
    """Tax collected on net supplies, by the rate of each day."""
    due = bps(F.col("amount_cents"), rate_on(ist_date(F.col("ts")), TCS))
    return payments.withColumn("due", due).filter("due IS NOT NULL").groupBy(by).agg(F.sum("due").alias("tcs_cents"))


def tcs_findings(payments: DataFrame, by: str, tolerance: int = 100) -> DataFrame:
    """Groups whose stated tax (tcs_cents) differs from that due on their net supplies, refunds included, by more than ``tolerance``.
    A group that states none isn't judged."""
    weight = F.col("amount_cents").cast("decimal(38,0)") * rate_on(ist_date(F.col("ts")), TCS)
    due = F.greatest(F.bround(F.coalesce(F.sum(weight), F.lit(0)) / F.lit(10_000).cast("decimal(5,0)"), 0).try_cast("bigint"), F.lit(0).cast("bigint"))
    each = payments.groupBy(by).agg(due.alias("expected_cents"), F.sum("tcs_cents").alias("actual_cents")).filter("actual_cents IS NOT NULL")
    return each.withColumn("difference_cents", F.col("expected_cents") - F.col("actual_cents")).filter(F.abs("difference_cents") > tolerance)


def itc(invoiced_gst: Column, deducted_gst: Column) -> Column:
    """Input tax credit: verdict and what may be claimed (the smaller of the two)."""
    verdict = F.when(F.abs(invoiced_gst - deducted_gst) <= 1, "matched").when(invoiced_gst > deducted_gst, "invoice_more").otherwise("invoice_less")
    return F.struct(verdict.alias("verdict"), F.least(invoiced_gst, deducted_gst).alias("claimable_cents"))


def claims(audited: DataFrame, bank: DataFrame, report: DataFrame) -> DataFrame:
    """What to ask back: overcharges, short credits, underpaid settlements; by kind and basis."""
    over = audited.filter("finding IN ('fee_overcharge', 'gst_on_principal', 'gst_mismatch') AND difference_cents > 0").select(
        F.col("finding").alias("kind"), F.lit("estimated").alias("basis"), F.col("difference_cents").alias("cents")
    )
    short = bank.filter("difference_cents < 0").select(F.lit("short_credit").alias("kind"), F.lit("stated").alias("basis"), (-F.col("difference_cents")).alias("cents"))
    absent = bank.filter("bank = 'not_found'").select(F.lit("not_received").alias("kind"), F.lit("stated").alias("basis"), F.col("net_cents").alias("cents"))
    under = report.filter("residual_cents > 0").select(F.lit("underpaid_settlement").alias("kind"), F.lit("stated").alias("basis"), F.col("residual_cents").alias("cents"))
    return over.unionByName(short).unionByName(absent).unionByName(under).groupBy("kind", "basis").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total_cents"))

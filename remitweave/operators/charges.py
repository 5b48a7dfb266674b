"""What a record says about its method, fee and tax, in either convention, and what it then adds to a deposit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitweave.functions import money
from remitweave.operators import fees

#: Words of a description that tell a method, tried in this order.
MEMO_WORDS = {
    "upi": ("upi",),
    "card": ("card", "visa", "mastercard", "rupay"),
    "netbanking": ("netbanking", "neft", "imps"),
    "wallet": ("wallet", "paytm", "phonepe"),
}


def stated(*columns: Column) -> Column:
    """The first of a record's method columns that isn't blank, by its usual name; null if none states one."""
    return fees.normal_method(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns]))


def detected(stated_method: Column, memo: Column) -> Column:
    """The stated method, else one that the description hints at, else ``unknown``."""
    hint = F.lit("unknown")
    for method, words in reversed(MEMO_WORDS.items()):
        hint = F.when(F.lower(memo).rlike("|".join(words)), method).otherwise(hint)
    return F.coalesce(stated_method, hint)


def fee_and_tax(fee_cents: Column, tax_cents: Column, fee_text: Column, tax_text: Column) -> Column:
    """Fee without tax, and tax. ``*_cents`` hold a fee that excludes tax; the texts of an export hold one that includes it."""
    gross, tax = money.amount_cents(fee_text), money.amount_cents(tax_text)
    return F.struct(
        F.coalesce(fee_cents, gross - F.coalesce(tax, F.lit(0))).alias("fee_cents"),
        F.when(fee_cents.isNotNull(), tax_cents).when(gross.isNotNull(), tax).alias("gst_cents"),
    )


def net_weights(payments: DataFrame, by: str) -> DataFrame:
    """What each payment adds to its settlement's net: its amount without its own method's fee and the tax withheld, for settlements whose
    payments state methods of at least two different rules. payments: ``by``, txn_id, amount_cents, method (null: the default card's rate).
    Refunds add their amount. One count of rules for each settlement is joined back."""
    amount = F.col("amount_cents")
    rule = F.when(F.col("method") == "netbanking", "flat").otherwise(F.coalesce(*[F.when(F.col("method") == m, F.lit(str(r))) for m, r in fees.CARD.items()], F.lit(str(fees.DEFAULT_BPS))))
    mixed = payments.filter((amount > 0) & F.col("method").isNotNull()).groupBy(by).agg(F.countDistinct(rule).alias("_n")).filter("_n >= 2").select(by)
    fee = F.coalesce(fees.expected_fee(amount, F.col("method")), fees.bps(amount, fees.DEFAULT_BPS))
    net = F.when(amount <= 0, amount).otherwise(amount - fee - fees.bps(amount, fees.DEFAULT_TAX_BPS))
    return payments.join(mixed, by, "left_semi").select(by, "txn_id", net.alias("weight_cents"))


def recorded(notices: DataFrame) -> DataFrame:
    """Chargeback notices, the latest of each id (txn_id, ref, amount_cents, ts)."""
    order = Window.partitionBy("txn_id").orderBy(F.desc("ts"), F.desc("amount_cents"))
    return notices.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def pending(reversals: DataFrame, taken: DataFrame) -> DataFrame:
    """Reversals that no settlement has taken yet, oldest first. taken: txn_id."""
    return reversals.join(taken.select("txn_id"), "txn_id", "left_anti").orderBy("ts", "txn_id")

"""Payment feeds derived from the generic test tables: gateway, ledger and bank rows, settlements and payment flows.

Money is integer minor units, times are UTC seconds since 1970. The same definitions stand in
``remitweave.plans.bridge_sql`` for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Methods by remainder of the part key.
METHODS = ("card", "upi", "netbanking", "wallet", "international_card")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def code(prefix: str, key: str, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), width, "0"))


def gateway(spark: SparkSession, sf_dir: str, by_ref: bool = False) -> DataFrame:
    """One payment per order line; an order's payments come six hours apart. ``by_ref``: the payments lie by their reference, for what counts by it; lines are moved as they
    were read, before texts are made of their numbers."""
    raw = table(spark, sf_dir, "lineitem")
    if by_ref:
        used = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate"]
        raw = raw.select(*used, code("ORD", "l_orderkey", 9).alias("_ref")).repartition("_ref")
    # an order has one reference: windows over both are windows over the order
    own = ["_ref", "ok"] if by_ref else ["ok"]
    order = Window.partitionBy(*own).orderBy("txn_id", "amount_cents")
    lines = raw.select(
        *own[:-1],
        F.col("l_orderkey").alias("ok"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("txn_id"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount_cents"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_linenumber").cast("bigint").alias("ln"),
        F.col("l_returnflag").alias("flag"),
        seconds("l_shipdate").alias("shipped"),
    )
    placed = lines.withColumn("place", F.row_number().over(order)).withColumn("start", F.min("shipped").over(Window.partitionBy(*own)))
    gross = F.col("amount_cents")
    fee = F.when(F.col("pk") % 5 == 1, 0).when(F.col("pk") % 5 == 2, 500).when(F.col("pk") % 5 == 4, F.bround(gross * 300 / 10000)).otherwise(F.bround(gross * 200 / 10000))
    return (
        placed.withColumn("ts", F.col("start") + F.least(F.col("place") - 1, F.lit(7)) * 21600)
        .withColumn("method", F.element_at(F.array(*map(F.lit, METHODS)), (F.col("pk") % 5 + 1).cast("int")))
        .withColumn("fee_cents", (fee + F.when(F.col("pk") % 17 == 0, 700).otherwise(0)).cast("bigint"))
        .withColumn("gst_cents", F.when(F.col("pk") % 19 == 0, F.bround(gross * 18 / 100)).otherwise(F.bround(F.col("fee_cents") * 1800 / 10000)).cast("bigint"))
        .select(
            F.lit("gateway").alias("source"),
            "txn_id",
            F.col("_ref").alias("ref") if by_ref else code("ORD", "ok", 9).alias("ref"),
            "amount_cents",
            F.when(F.col("pk") % 50 == 0, "USD").when(F.col("pk") % 77 == 0, "AED").otherwise("INR").alias("currency"),
            "ts",
            F.when((F.col("flag") == "R") & (F.col("ln") == 7), "failed").when(F.col("pk") % 41 == 0, "On-Hold").otherwise("captured").alias("status"),
            F.concat(F.lit("P"), (F.col("ok") % 997).cast("string")).alias("payer_id"),
            F.concat(F.lit("M"), (F.col("sk") % 10).cast("string")).alias("payee_id"),
            F.concat(F.lit("payment "), code("STL", "ok", 9), F.lit(" via "), F.col("method")).alias("memo"),
            "method",
            "fee_cents",
            "gst_cents",
            "ok",
            "ln",
            "pk",
        )
    )


def ledger(payments: DataFrame) -> DataFrame:
    """The merchant's books: two payments in three, an hour later."""
    return payments.filter(F.col("ln") % 3 != 0).select(
        F.lit("erp").alias("source"),
        F.concat(F.lit("JV"), F.col("txn_id")).alias("txn_id"),
        "ref",
        "amount_cents",
        "currency",
        (F.col("ts") + 3600).alias("ts"),
        F.concat(F.lit("sale "), F.col("ref")).alias("memo"),
        "ok",
        "ln",
    )


def booked(payments: DataFrame) -> DataFrame:
    """The payments and, beside each that the books hold, its row of ``ledger``: the rows of both where the payments lie, in one pass. ``home``: the payment's reference."""
    erp = F.col("source") == "erp"
    feeds = F.when(F.col("ln") % 3 != 0, F.array(F.lit("gateway"), F.lit("erp"))).otherwise(F.array(F.lit("gateway")))
    each = payments.drop("source").select("*", F.explode(feeds).alias("source"))
    return each.select(
        "source",
        F.when(erp, F.concat(F.lit("JV"), F.col("txn_id"))).otherwise(F.col("txn_id")).alias("txn_id"),
        "ref",
        "amount_cents",
        F.when(erp, F.col("ts") + 3600).otherwise(F.col("ts")).alias("ts"),
        "ok",
        "ln",
        "pk",
        F.col("ref").alias("home"),
    )


def settlements(payments: DataFrame) -> DataFrame:
    """One per order, with planted differences by the order's remainder."""
    odd = F.col("ok") % 16
    return (
        payments.groupBy("ok")
        .agg(F.sum("amount_cents").alias("gross"), F.sum(F.col("fee_cents") + F.col("gst_cents")).alias("deductions"), F.min("ts").alias("first_ts"))
        .select(
            code("STL", "ok", 9).alias("settlement_id"),
            (F.col("gross") - F.col("deductions") + F.when(odd == 1, 12345).when(odd == 2, 6).otherwise(0)).alias("net_cents"),
            F.col("deductions").alias("declared_deductions"),
            (F.col("first_ts") + 172800).alias("settled_at"),
            code("UTR", "ok", 12).alias("utr"),
            "ok",
        )
    )


def bank(settled: DataFrame) -> DataFrame:
    """Bank credits: some missing, some short, some without the transfer number."""
    return settled.filter(F.col("ok") % 10 != 9).select(
        code("BNK", "ok", 9).alias("entry_id"),
        (F.col("net_cents") - F.when(F.col("ok") % 13 == 0, 100).otherwise(0)).alias("amount_cents"),
        F.when(F.col("ok") % 11 == 0, "NEFT CREDIT").otherwise(F.concat(F.lit("NEFT CR "), F.col("utr"), F.lit(" SETTLEMENT"))).alias("description"),
        (F.col("settled_at") + 86400).alias("ts"),
        "ok",
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User payments for screening rules."""
    return table(spark, sf_dir, "events").select(
        F.lit("gateway").alias("source"),
        F.col("event_id").cast("string").alias("txn_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("payer_id"),
        F.concat(F.lit("M"), (F.col("event_id") % 7).cast("string")).alias("payee_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount_cents"),
        seconds("ts").alias("ts"),
        (F.col("event_id") % 3 == 0).alias("is_cash"),
        (F.col("event_id") % 5 == 0).alias("is_wire"),
        F.col("event_type").alias("memo"),
    )


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows, every 97th of them a second time under another id, and for every 89th three payments that lead its payer's money back through two other accounts."""
    rows = flows(spark, sf_dir)
    id_ = F.col("txn_id").cast("bigint")
    again = rows.filter(id_ % 97 == 0).withColumn("txn_id", F.concat(F.lit("R"), "txn_id"))
    first, second = F.concat(F.lit("A"), "txn_id"), F.concat(F.lit("B"), "txn_id")
    legs = F.array(*[
        F.struct(F.lit(k).alias("leg"), a.alias("from"), b.alias("to")) for k, (a, b) in enumerate([(F.col("payer_id"), first), (first, second), (second, F.col("payer_id"))])
    ])
    round_trip = rows.filter(id_ % 89 == 0).withColumn("leg", F.explode(legs)).select(
        "source", F.concat_ws("-", F.lit("C"), "txn_id", "leg.leg").alias("txn_id"), F.col("leg.from").alias("payer_id"), F.col("leg.to").alias("payee_id"), "amount_cents",
        (F.col("ts") + 3600 * (F.col("leg.leg") + 1)).alias("ts"), "is_cash", "is_wire", "memo",
    )
    return rows.unionByName(again).unionByName(round_trip)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments between numbered accounts, one for each line: from the customer's number to the part's, at the shipping time."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("txn_id"),
            F.col("o_custkey").cast("bigint").alias("payer"),
            F.col("l_partkey").cast("bigint").alias("payee"),
            seconds("l_shipdate").alias("ts"),
        )
    )

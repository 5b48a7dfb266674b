"""Does a settlement add up, did the bank receive it, do the books know its payments?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitweave.functions import narration


def tie_out(settlements: DataFrame, payments: DataFrame, *more: Column) -> DataFrame:
    """Per settlement: members, their gross and net sums, ``more`` aggregates of them, and the residual against the stated net.

    settlements: settlement_id, ok, net_cents; payments: ok, amount_cents, fee_cents, gst_cents.
    """
    sums = payments.groupBy("ok").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.sum("amount_cents").alias("gross_cents"),
        F.sum(F.col("amount_cents") - F.col("fee_cents") - F.col("gst_cents")).alias("computed_net_cents"),
        *more,
    )
    n = F.coalesce("n_members", F.lit(0))
    residual = F.coalesce("computed_net_cents", F.lit(0)) - F.col("net_cents")
    return (
        settlements.join(sums, "ok", "left")
        .withColumn("n_members", n)
        .withColumn("residual_cents", residual)
        .withColumn("tie_out", F.when(n == 0, "no_lines").when(residual == 0, "ties_out").otherwise("does_not_tie_out"))
    )


def bank_check(settlements: DataFrame, credits: DataFrame) -> DataFrame:
    """Best bank credit of each settlement: transfer number and amount, number only, amount only, none.

    Transfer numbers, in any form that a narration gives them, are taken out of the descriptions, so that both lookups are equality joins; a credit's id, and its reference if
    there is one, may be the number too.
    """
    rows = credits.withColumn("found_utr", narration.transfer_number(F.col("description")))
    whole = [F.nullif(F.regexp_replace(bare(F.col(c)), "^UTR", ""), F.lit("")) for c in ("entry_id", "ref") if c in credits.columns]
    numbers = F.explode(F.array_distinct(F.array_compact(F.array("found_utr", *whole))))
    by_utr = settlements.join(
        rows.select(numbers.alias("_number"), "entry_id", F.col("amount_cents").alias("credit")),
        F.nullif(F.regexp_replace(bare(F.col("utr")), "^UTR", ""), F.lit("")) == F.col("_number"),
    ).select("settlement_id", "entry_id", "credit", F.when(F.col("credit") == F.col("net_cents"), 0).otherwise(1).alias("tier"))
    by_amount = settlements.join(
        rows.filter("found_utr IS NULL").select("entry_id", F.col("amount_cents").alias("credit"), F.col("ts")),
        (F.col("net_cents") == F.col("credit")) & F.col("ts").between(F.col("settled_at") - 7 * 86400, F.col("settled_at") + 7 * 86400),
    ).select("settlement_id", "entry_id", "credit", F.lit(2).alias("tier"))
    best = by_utr.unionByName(by_amount).groupBy("settlement_id").agg(F.min(F.struct("tier", "entry_id", "credit")).alias("b"))
    tier = F.col("b.tier")
    verdict = F.when(tier == 0, "arrived").when(tier == 1, "amount_differs").when(tier == 2, "amount_only").otherwise("not_found")
    return settlements.join(best, "settlement_id", "left").select(
        "settlement_id",
        "net_cents",
        verdict.alias("bank"),
        F.col("b.entry_id").alias("entry_id"),
        F.when(F.col("b.tier") == 1, F.col("b.credit") - F.col("net_cents")).otherwise(0).alias("difference_cents"),
    )


def voucher_key(txn_id: Column) -> Column:
    """A payment's number without the voucher marks that books put before it."""
    return F.regexp_replace(txn_id, "^(JV)+", "")


def books_check(payments: DataFrame, ledger: DataFrame) -> DataFrame:
    """Payments that the ledger doesn't know by their number, with or without voucher marks."""
    known = ledger.select(voucher_key(F.col("txn_id")).alias("_key"))
    return payments.withColumn("_key", voucher_key(F.col("txn_id"))).join(known, "_key", "left_anti").drop("_key")


def status(tie: Column, bank: Column, missing: Column) -> Column:
    return (
        F.when(tie == "no_lines", "no_lines")
        .when((tie == "does_not_tie_out") | bank.isin("amount_differs", "not_found"), "not_verified")
        .when((missing > 0) | (bank == "amount_only"), "verified_with_findings")
        .otherwise("verified")
    )


def settlement_report(settlements: DataFrame, payments: DataFrame, credits: DataFrame, ledger: DataFrame) -> DataFrame:
    """The checks together, one row per settlement. Payments are read once: what the books don't know is marked first, and sums and missing ones are one aggregate."""
    known = ledger.select(voucher_key(F.col("txn_id")).alias("_key")).distinct().withColumn("_known", F.lit(True))
    marked = payments.select("ok", "amount_cents", "fee_cents", "gst_cents", voucher_key(F.col("txn_id")).alias("_key")).join(known, "_key", "left")
    tied = tie_out(settlements, marked, F.count_if(F.col("_known").isNull()).alias("missing_in_books"))
    return (
        tied.join(bank_check(settlements, credits).select("settlement_id", "bank"), "settlement_id")
        .withColumn("missing_in_books", F.coalesce("missing_in_books", F.lit(0)))
        .withColumn("status", status(F.col("tie_out"), F.col("bank"), F.col("missing_in_books")))
        .select("settlement_id", "n_members", "net_cents", "residual_cents", "tie_out", "bank", "missing_in_books", "status")
    )


def checks(report: DataFrame, fee_findings: DataFrame, blind: DataFrame) -> DataFrame:
    """Five independent verdicts on each settlement, and its status: one that contradicts it outweighs findings, which outweigh none.

    report: ``settlement_report``; where its column ``derived`` holds, the net is the sum of the settlement's own lines, which proves nothing by itself: then the bank's credit counts instead.
    fee_findings: settlement_id, a row for each. blind: settlement_id, agrees (``review.blind_check``), of settlements that were solved without their evidence."""
    found = fee_findings.groupBy("settlement_id").agg(F.count(F.lit(1)).alias("n_fee_findings"))
    derived = F.col("derived") if "derived" in report.columns else F.lit(False)
    rows = (
        report.join(found, "settlement_id", "left")
        .join(blind.select("settlement_id", "agrees"), "settlement_id", "left")
        .withColumn("n_fee_findings", F.coalesce("n_fee_findings", F.lit(0)))
        .withColumn("tie_out", F.when(derived & (F.col("tie_out") != "no_lines"), "derived").otherwise(F.col("tie_out")))
        .withColumn("blind_solve", F.when(F.col("agrees"), "agrees").when(~F.col("agrees"), "disagrees").otherwise("not_solved"))
        .withColumn("books", F.when(F.col("missing_in_books") > 0, "missing_in_books").otherwise("all_booked"))
        .withColumn("fees", F.when(F.col("n_fee_findings") > 0, "findings").otherwise("clean"))
    )
    bad = (F.col("tie_out") == "does_not_tie_out") | (F.col("blind_solve") == "disagrees") | F.col("bank").isin("amount_differs", "not_found")
    unproven = (F.col("tie_out") == "derived") & (F.col("bank") != "arrived")
    soft = unproven | (F.col("books") == "missing_in_books") | (F.col("bank") == "amount_only") | (F.col("fees") == "findings")
    return rows.withColumn("status", F.when(F.col("n_members") == 0, "no_lines").when(bad, "not_verified").when(soft, "verified_with_findings").otherwise("verified")).select(
        "settlement_id", "n_members", "tie_out", "blind_solve", "bank", "books", "fees", "n_fee_findings", "status"
    )


def report_summary(report: DataFrame) -> DataFrame:
    """Settlements and value by status, one column per bank verdict."""
    return (
        report.groupBy("status")
        .pivot("bank", ["arrived", "amount_differs", "amount_only", "not_found"])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def members_by_type(lines: DataFrame) -> DataFrame:
    """Lines and value by settlement and type; with settlement null, of what hasn't been paid out yet."""
    return lines.groupBy("settlement_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("value_cents"))


def settlements_from_lines(lines: DataFrame) -> DataFrame:
    """Settlements derived from report lines: net sum, first transfer number, latest time."""
    return lines.groupBy("settlement_id").agg(F.sum("net_cents").alias("net_cents"), F.min("utr").alias("utr"), F.max("ts").alias("settled_at"))


def bare(text: Column) -> Column:
    """Letters and digits only, upper case: the form in which names are looked for in texts."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]", ""))


def settlement_credit(settlements: DataFrame, credits: DataFrame) -> DataFrame:
    """The credit that is a settlement's payout: of those of exactly the net amount on its day the only one whose description (or reference, if there is one) names the
    settlement, or the only one at all, if none does."""
    said = F.concat_ws(" ", *[bare(F.col(c)) for c in ("description", "ref") if c in credits.columns])
    same = settlements.join(
        credits.select("entry_id", "amount_cents", F.col("ts").alias("credited_at"), said.alias("_said")),
        (F.col("net_cents") == F.col("amount_cents")) & F.col("credited_at").between(F.col("settled_at"), F.col("settled_at") + 86400),
    ).withColumn("_named", F.contains("_said", bare(F.col("settlement_id"))) & (bare(F.col("settlement_id")) != ""))
    one = F.when(F.col("n_named") == 1, F.col("named_id")).when((F.col("n_named") == 0) & (F.col("n") == 1), F.col("only_id"))
    return (
        same.groupBy("settlement_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("_named").alias("n_named"), F.min(F.when(F.col("_named"), F.col("entry_id"))).alias("named_id"), F.min("entry_id").alias("only_id"))
        .select("settlement_id", one.alias("entry_id"))
        .filter("entry_id IS NOT NULL")
    )


def cash_position(settlements: DataFrame, payments: DataFrame, credits: DataFrame, cleared: DataFrame, held: DataFrame) -> DataFrame:
    """Disjoint buckets with counts and sums. cleared: ok; held: txn_id of blocked payments."""
    flagged = (
        payments.join(cleared.select("ok", F.lit(True).alias("clear")), "ok", "left")
        .join(held.select("txn_id", F.lit(True).alias("hold")), "txn_id", "left")
        .select("amount_cents", F.coalesce("clear", F.lit(False)).alias("clear"), F.coalesce("hold", F.lit(False)).alias("hold"))
    )
    paid = flagged.select(
        F.when(F.col("hold"), "compliance_hold").when(F.col("clear"), "reconciled_settled").otherwise("gateway_in_transit").alias("bucket"), "amount_cents"
    )
    taken = settlements.join(cleared.select("ok"), "ok", "left_semi").select(F.lit("deductions").alias("bucket"), F.col("declared_deductions").alias("amount_cents"))
    unexplained = credits.join(cleared.select("ok"), "ok", "left_anti").select(F.lit("bank_unexplained").alias("bucket"), "amount_cents")
    return paid.unionByName(taken).unionByName(unexplained).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("total_cents"))


def journal(settlements: DataFrame, payments: DataFrame) -> DataFrame:
    """Balanced double entries of settlements whose lines balance: bank, fees and tax against gross."""
    sums = payments.groupBy("ok").agg(F.sum("amount_cents").alias("gross"), F.sum("fee_cents").alias("fees"), F.sum("gst_cents").alias("tax"))
    lines = settlements.join(sums, "ok").filter(F.col("net_cents") + F.col("fees") + F.col("tax") == F.col("gross"))
    entry = lambda account, debit, credit: F.struct(F.lit(account).alias("account"), debit.alias("debit_cents"), credit.alias("credit_cents"))
    zero = F.lit(0).cast("bigint")
    return lines.select(
        "settlement_id",
        F.explode(
            F.array(
                entry("Bank", F.col("net_cents"), zero), entry("Gateway fees", F.col("fees"), zero), entry("Input GST", F.col("tax"), zero), entry("Gateway receivable", zero, F.col("gross"))
            )
        ).alias("e"),
    ).select("settlement_id", "e.*")


def imbalance(entries: DataFrame) -> DataFrame:
    return entries.groupBy("settlement_id").agg((F.sum("debit_cents") - F.sum("credit_cents")).alias("imbalance_cents"))


def contested(claims: DataFrame) -> DataFrame:
    """Payments claimed by more than one settlement, with each pair once. claims: settlement_id, txn_key."""
    per = Window.partitionBy("txn_key")
    shared = claims.distinct().withColumn("n", F.count(F.lit(1)).over(per)).filter("n > 1")
    a, b = shared.alias("a"), shared.alias("b")
    return a.join(b, (F.col("a.txn_key") == F.col("b.txn_key")) & (F.col("a.settlement_id") < F.col("b.settlement_id"))).groupBy(
        F.col("a.settlement_id").alias("first"), F.col("b.settlement_id").alias("second")
    ).agg(F.count(F.lit(1)).alias("shared"))


def double_claimed(claims: DataFrame) -> DataFrame:
    """Settlements to withhold: all that hold a payment another one also cleared."""
    keys = claims.groupBy("txn_key").agg(F.countDistinct("settlement_id").alias("n")).filter("n > 1").select("txn_key")
    return claims.join(keys, "txn_key", "left_semi").select("settlement_id").distinct()


def aliases(key: Column) -> Column:
    """A payment's key with and without its feed."""
    return F.array_distinct(F.array(key, F.substring_index(key, ":", -1)))


def already_settled(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """Claims on payments that a different settlement settled before. ledger: txn_key, owner."""
    ours = claims.withColumn("alias", F.explode(aliases(F.col("txn_key"))))
    theirs = ledger.withColumn("alias", F.explode(aliases(F.col("txn_key")))).select("alias", "owner")
    hit = ours.join(theirs, "alias").filter("owner <> settlement_id").select("settlement_id", "txn_key", "owner").distinct()
    return hit.groupBy("settlement_id", "owner").agg(F.count(F.lit(1)).alias("n"))


def first_writer(ledger: DataFrame, claims: DataFrame) -> DataFrame:
    """The ledger after ``claims`` (settlement_id, txn_key, at): a payment belongs to whoever claimed it first."""
    new = claims.join(ledger.select("txn_key"), "txn_key", "left_anti")
    first = new.groupBy("txn_key").agg(F.min_by("settlement_id", F.struct("at", "settlement_id")).alias("owner"))
    return ledger.select("txn_key", "owner").unionByName(first)

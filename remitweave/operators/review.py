"""Around a verdict: twins, double counting, joint pools, profiles, summaries, proposals and the blind check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest write-off, working days to wait, materiality of a false clear in basis points.
WRITE_OFF, WAIT_DAYS = 100, 10
COST_BPS = {"cleared": 0, "withheld": 500, "unmatched": 1000}


def counted_twice(matched: DataFrame) -> DataFrame:
    """Matched payments of one settlement that stand in two feeds under one reference and amount."""
    key = ["settlement_id", "ref", "amount_cents"]
    return matched.groupBy(*key).agg(F.countDistinct("source").alias("feeds"), F.count(F.lit(1)).alias("n")).filter("feeds > 1")


def member_twin(others: DataFrame, members: DataFrame) -> DataFrame:
    """Each record of another feed with the member-feed record of its reference and amount (smallest id), if there is one."""
    own = members.groupBy("ref", "amount_cents").agg(F.min("txn_id").alias("twin_id"))
    return others.join(own, ["ref", "amount_cents"], "left").select("txn_id", "twin_id")


def union_pool(candidates: DataFrame, anchored: DataFrame) -> DataFrame:
    """One row per candidate with the settlements it may belong to: those that it names, else all whose pool has it."""
    eligible = candidates.groupBy("txn_key").agg(F.array_sort(F.collect_set("settlement_id")).alias("pools"))
    named = anchored.groupBy("txn_key").agg(F.array_sort(F.collect_set("settlement_id")).alias("named"))
    return eligible.join(named, "txn_key", "left").select(
        "txn_key", F.array_join(F.coalesce(F.array_intersect("pools", "named"), F.col("pools")), ",").alias("eligible"), F.col("named").isNotNull().alias("bound")
    )


def without_siblings(candidates: DataFrame, anchored: DataFrame) -> DataFrame:
    """Candidates that no other settlement has anchored. Owners are one row per payment, so that candidates are joined once."""
    owners = anchored.groupBy("txn_key").agg(F.min("settlement_id").alias("_lo"), F.max("settlement_id").alias("_hi"))
    other = lambda c: F.coalesce(F.col(c) != F.col("settlement_id"), F.lit(False))
    return candidates.join(owners, "txn_key", "left").filter(~other("_lo") & ~other("_hi")).select(*candidates.columns)


def matched_rows(members: DataFrame, payments: DataFrame) -> DataFrame:
    """The payments of each matched set (settlement_id, txn_key), the largest first."""
    order = Window.partitionBy("settlement_id").orderBy(F.desc("amount_cents"), "txn_key")
    return members.join(payments, "txn_key").withColumn("place", F.row_number().over(order))


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: distinct share, share of dates, of numbers (bare integers weigh 0.4), of identifiers, mean length."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("e")).select("e.*").filter("v IS NOT NULL AND v <> ''")
    date = F.try_to_timestamp("v").isNotNull() & F.col("v").rlike("^[0-9]{4}-")
    amount = F.when(F.col("v").rlike(r"^[+-]?[0-9]+$"), 0.4).when(F.col("v").rlike(r"^[+-]?[0-9][0-9,]*\.[0-9]+$"), 1.0).otherwise(0.0)
    return long.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("v").alias("n_distinct"),
        F.round(F.avg(date.cast("double")), 6).alias("date_share"),
        F.round(F.avg(amount), 6).alias("amount_share"),
        F.round(F.avg(F.col("v").rlike("^[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*$").cast("double")), 6).alias("identifier_share"),
        F.round(F.avg(F.length("v")), 6).alias("mean_length"),
    )


def blind_check(truth: DataFrame, found: DataFrame, found_only: bool = False) -> DataFrame:
    """Per settlement, members proposed without its evidence against the true ones: equal, or what is missing and extra. Both are moved once, to their settlement.
    ``found_only``: settlements without any proposed member are left out."""
    rows = [df.select("settlement_id", "txn_key", F.lit(side).alias("_true")) for df, side in ((truth, True), (found, False))]
    both = rows[0].unionByName(rows[1]).repartition("settlement_id")
    each = both.groupBy("settlement_id", "txn_key").agg(F.count_if("_true").alias("t"), F.count_if(~F.col("_true")).alias("f"))
    none = F.lit(0).cast("bigint")
    counts = each.groupBy("settlement_id").agg(
        F.sum(F.when(F.col("f") == 0, F.col("t")).otherwise(none)).alias("missing"), F.sum(F.when(F.col("t") == 0, F.col("f")).otherwise(none)).alias("extra"), F.max("f").alias("_any")
    )
    asked = counts.filter(F.col("_any") > 0) if found_only else counts
    return asked.drop("_any").withColumn("agrees", (F.col("missing") == 0) & (F.col("extra") == 0))


def false_clear_cost(net: Column, state: Column) -> Column:
    out = F.lit(COST_BPS["unmatched"])
    for name, rate in COST_BPS.items():
        out = F.when(state == name, rate).otherwise(out)
    return F.bround(F.abs(net) * out / 10000).cast("bigint")


def proposal(residual: Column, ambiguous: Column, age_days: Column, has_members: Column) -> Column:
    """The next step by fixed rules: write off small change, wait for late payments, ask, or pass on."""
    return (
        F.when(has_members & (residual == 0) & ~ambiguous, "accept")
        .when(has_members & ~ambiguous & (F.abs(residual) <= WRITE_OFF), "write_off")
        .when(ambiguous, "ask")
        .when(age_days <= WAIT_DAYS, "wait")
        .otherwise("escalate")
    )


def deciding_member(alternatives: DataFrame) -> DataFrame:
    """alternatives: settlement_id, alternative, txn_key. The payment that splits a settlement's alternatives most evenly."""
    total = alternatives.groupBy("settlement_id").agg(F.countDistinct("alternative").alias("k"))
    each = alternatives.groupBy("settlement_id", "txn_key").agg(F.countDistinct("alternative").alias("n")).join(total, "settlement_id").filter("n < k")
    order = Window.partitionBy("settlement_id").orderBy(F.abs(2 * F.col("n") - F.col("k")), "txn_key")
    return each.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("settlement_id", "txn_key", "n", "k")


def summary(settlement: Column, status: Column, n: Column, residual: Column) -> Column:
    """The outcome in a sentence."""
    return (
        F.when(status == "verified", F.format_string("%s: %d payments add up to the deposit, and all of them are in the books.", settlement, n))
        .when(status == "verified_with_findings", F.format_string("%s: %d payments add up to the deposit; see the findings.", settlement, n))
        .when(status == "no_lines", F.format_string("%s: no payment belongs to this deposit.", settlement))
        .otherwise(F.format_string("%s: not verified, %d minor units remain.", settlement, residual))
    )


def scores(results: DataFrame) -> DataFrame:
    """results: cleared, right, solvable. How verdicts turn out: cleared right, false clears, right refusals, missed."""
    kind = (
        F.when(F.col("cleared") & F.col("right"), "auto_cleared_correct")
        .when(F.col("cleared"), "false_clear")
        .when(~F.col("solvable"), "correct_abstention")
        .otherwise("missed")
    )
    return results.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))

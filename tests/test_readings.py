"""Narrations, amounts, calendars, yearly thresholds and cut pools: small cases."""

import pytest
from pyspark.sql import functions as F

from remitweave.functions import money, narration, times
from remitweave.operators import compliance, fees, linkage, subset_sum
from remitweave.plans import catalog


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("neft cr utr: 123456789012 ACME Traders", ("NEFT", "123456789012", None, "ACME TRADERS")),
        ("RTGS HDFCR52020010112345678 SETTLE-000123", ("RTGS", "HDFCR52020010112345678", "SETTLE-000123", None)),
        ("IMPS 444444444444 HDFC0001234 blue  sky pvt ltd", ("IMPS", "444444444444", None, "BLUE SKY PVT LTD")),
        ("ach setl_AbC12345 UTRAXIS1234567", ("NACH", "AXIS1234567", "setl_AbC12345", None)),
        ("CLG/FROM NORTH STAR & CO PVT. LTD./x", ("CHQ", None, None, "NORTH STAR & CO PVT. LTD.")),
        ("UTR HDFC0001234 Ltd", (None, None, None, None)),
        (None, (None,) * 4),
    ],
)
def test_narrations(spark, text, want):
    c = F.col("t")
    row = spark.createDataFrame([(text,)], "t string").select(narration.rail(c), narration.utr(c), narration.settlement_ref(c), narration.counterparty(c)).first()
    assert tuple(row) == want


def test_amounts(spark):
    want = {"AUD 1,200.50": 120050, "SGD. 5": 500, "¥ 500": 50000, "Rs. 1,23,456.789 Cr": 12345679, "(45.10)": -4510, "1" * 25: "out of range", "9" * 44: "out of range", "": "empty"}
    c = F.col("t")
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", F.coalesce(money.amount_cents(c).cast("string"), money.amount_error(c)).alias("v"))
    assert {r["t"]: r["v"] for r in rows.collect()} == {k: str(v) for k, v in want.items()}
    digits = spark.createDataFrame([("isk",), ("IQD",), ("INR",)], "c string").select(money.minor_units(F.col("c")).alias("n"))
    assert [r["n"] for r in digits.collect()] == [0, 3, 2]


def test_days_outside_the_calendar_stay(spark):
    dim = times.calendar(spark, "2024-01-01", "2024-01-31")
    rows = spark.sql("SELECT DATE '2024-01-24' AS a, DATE '2024-01-30' AS b UNION ALL SELECT DATE '2030-01-01', DATE '2024-01-02' UNION ALL SELECT NULL, NULL")
    out = times.working_days_between(times.add_working_days(rows, "a", 2, dim, "due"), "a", "b", dim, "n").collect()
    assert sorted((str(r["a"]), str(r["due"]), r["n"]) for r in out) == [("2024-01-24", "2024-01-29", 3), ("2030-01-01", "None", None), ("None", "None", None)]


def test_tax_threshold_starts_again_each_april(spark):
    rows = [("p", "t1", 900, "2021-05-01"), ("p", "t2", 900, "2022-03-30"), ("p", "t3", 900, "2022-04-02")]
    txns = spark.createDataFrame(rows, "payer_id string, txn_id string, amount_cents long, d string").withColumn("ts", F.unix_timestamp(F.col("d").cast("timestamp")))
    assert [(r["taxable_cents"], r["tds_cents"]) for r in fees.tds(txns, "payer_id", 1000).collect()] == [(800, 8)]


def test_severities(spark):
    got = {r["rule_id"]: r["severity"] for r in compliance.rulebook(spark).collect()}
    assert (got["SANCTIONS_POTENTIAL_MATCH"], got["DORMANT_ACCOUNT_SPIKE"], got["KEYWORD_ALERT"]) == ("HIGH", "LOW", "MEDIUM")


def test_a_cut_pool_withholds_what_search_finds(spark):
    def pool(anchored):
        rows = [("s", f"k{i:03d}", 1 << (i % 20), i < anchored, 1.0 - i / 100, 7) for i in range(30)]
        return spark.createDataFrame(rows, "settlement_id string, txn_key string, amount_cents long, anchor boolean, score double, target_cents long").withColumn("n_pool", F.lit(30))

    cut = linkage.capped(pool(0), 10)
    assert {r["truncated"] for r in cut.collect()} == {True} and cut.count() == 10
    found = subset_sum.match(cut, tolerance=0).first()
    assert (found["outcome"], found["confidence"], found["members"]) == ("truncated", 0.0, "")
    whole = subset_sum.match(linkage.capped(pool(3), 10), tolerance=0).first()  # the anchored set is whole
    assert (whole["tier"], whole["outcome"], whole["members"]) == ("anchor", "unique", "k000,k001,k002")
    assert {r["truncated"] for r in linkage.capped(pool(0), 30).collect()} == {False}


def test_no_false_clear(spark):
    rows = {r["kind"]: r["n"] for r in catalog.QUERIES["verdict_scores"](spark, "/root/testdata/sf0.001").collect()}
    assert rows.get("false_clear", 0) == 0 and sum(rows.values()) > 0

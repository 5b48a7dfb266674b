"""Rates declared and published, tax stated, lines by type: small cases."""

import datetime as dt

from remitweave.operators import fees, rates, tie_out

D = dt.date


def test_only_foreign_payments_without_a_rate_count(spark):
    rows = [("S", "INR", "usd", True), ("S", "INR", "USD", True), ("S", "INR", "inr", True), ("S", "INR", "EUR", False), ("S", "INR", None, True), ("S", "INR", "AED", True), ("T", "INR", "AED", True)]
    paid = spark.createDataFrame(rows, "settlement_id string, home string, currency string, currency_stated boolean")
    said = spark.createDataFrame([("S", "aed")], "settlement_id string, currency string")
    assert sorted(map(tuple, rates.undeclared(paid, said).collect())) == [("S", "USD", 2), ("T", "AED", 1)]


def test_declared_rates_are_held_against_the_last_published_one(spark):
    published = spark.createDataFrame([("USD", D(2024, 1, 1), 80.0), ("USD", D(2024, 1, 4), 90.0), ("EUR", D(2024, 1, 1), 0.0)], "currency string, day date, rate double")
    said = [("a", "USD", D(2024, 1, 1), 82.4), ("b", "USD", D(2024, 1, 3), 82.5), ("c", "USD", D(2024, 1, 4), 82.5), ("d", "USD", D(2023, 12, 31), 1.0), ("e", "USD", D(2024, 2, 3), 1.0), ("f", "USD", D(2024, 2, 4), 1.0), ("g", "EUR", D(2024, 1, 1), 1.0), ("h", "USD", None, 1.0)]
    got = rates.gaps(spark.createDataFrame(said, "settlement_id string, currency string, day date, rate double"), published).collect()
    assert {r["settlement_id"]: (r["reference"], round(r["gap"], 4)) for r in got} == {"b": (80.0, 0.0312), "c": (90.0, -0.0833), "e": (90.0, -0.9889)}


def test_stated_tax_nets_refunds_and_silence_is_not_judged(spark):
    ts = 1_720_000_000  # before the rate fell
    rows = [(1, 1_000_000, ts, 10_000), (1, -500_000, ts, -4_899), (2, 1_000_000, ts, None), (3, 1_000_000, ts, 9_900), (4, -1_000_000, ts, -500), (5, 1_000_000, 1_000_000_000, 101)]
    found = fees.tcs_findings(spark.createDataFrame(rows, "ok long, amount_cents long, ts long, tcs_cents long"), "ok").collect()
    assert {r["ok"]: (r["expected_cents"], r["actual_cents"], r["difference_cents"]) for r in found} == {1: (5000, 5101, -101), 4: (0, -500, 500), 5: (0, 101, -101)}


def test_lines_by_type_keep_what_is_not_paid_out(spark):
    rows = [("S", "payment", 5), ("S", "payment", 6), ("S", "refund", -1), (None, "payment", 9)]
    got = tie_out.members_by_type(spark.createDataFrame(rows, "settlement_id string, type string, amount_cents long")).collect()
    assert {tuple(r) for r in got} == {("S", "payment", 2, 11), ("S", "refund", 1, -1), (None, "payment", 1, 9)}

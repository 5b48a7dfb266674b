"""Uploaded files to verdicts, checks of a settlement, and who acts on an exception, on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from remitweave.functions import refs
from remitweave.operators import exceptions, tie_out, upload
from remitweave.sources import files, lists

SETTLED = "settlement_id string, net_cents long, declared_deductions long"


def settled(spark):
    return spark.createDataFrame([("STL0001", 2900, 100), ("STL0002", 700, 0), ("STL0003", 10, 0)], SETTLED)


ROWS = [
    ("P1", "10.00", "2024-01-05T10:00:00Z", "pay STL0001 now", "INR", "captured"),
    ("P2", "20.00", "2024-01-05T11:00:00Z", "stl0001", "inr", ""),
    ("P3", "7.00", "2024-01-06T11:00:00Z", "for STL0002 and STL0002", None, "captured"),
    ("P4", "7.00", "2024-01-06T11:00:00Z", "for STL0002", "USD", "captured"),
    ("P5", "7.00", "2024-01-06T11:00:00Z", "for STL0002", "INR", "Failed"),
    ("P6", "1.00", "2024-01-06T11:00:00Z", "", "INR", "captured"),
]
NAMES = ["Payment ID", "Amount", "Date", "Narration", "Currency", "Status"]


def outcome(run):
    return {r.settlement_id: (r.n_pool, r.residual_cents, r.cleared) for r in run.verdicts.collect()}


def test_csv_and_json_agree(spark, tmp_path):
    rows = [*ROWS, ROWS[0], ("P7", "n/a", "2024-01-06T11:00:00Z", "STL0003", "INR", "captured")]
    spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in NAMES)).write.csv(str(tmp_path / "c"), header=True)
    (tmp_path / "j.json").write_text(json.dumps([dict(zip(NAMES, r, strict=True)) for r in rows]))
    want = {"STL0001": (2, 0, True), "STL0002": (1, 0, True)}
    for form, path in (("csv", tmp_path / "c"), ("json", tmp_path / "j.json")):
        run = upload.run(spark, str(path), settled(spark), form=form)
        assert outcome(run) == want
        assert {r.step: r.n for r in run.steps.collect()} == {"read": 8, "repeated": 1, "unreadable": 1, "not_settling": 1, "other_currency": 1, "used": 4}
        assert [(r.txn_id, r.error.startswith("amount")) for r in run.rejected.collect()] == [("P7", True)]
        assert {tuple(r) for r in run.links.collect()} == {("STL0001", "gateway:P1"), ("STL0001", "gateway:P2"), ("STL0002", "gateway:P3")}


def test_empty_and_unreadable_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text(",".join(NAMES) + "\n")
    run = upload.run(spark, str(tmp_path / "e.csv"), settled(spark))
    assert outcome(run) == {} and {r.step: r.n for r in run.steps.collect()}["used"] == 0
    (tmp_path / "b.csv").write_text(",".join(NAMES) + "\n" + "".join(f"P{k},none,2024-01-05,x,INR,captured\n" for k in range(5)))
    with pytest.raises(ValueError, match="unreadable"):
        upload.run(spark, str(tmp_path / "b.csv"), settled(spark))
    (tmp_path / "m.csv").write_text("Payment ID,Fee Amount\nP1,3.00\n")
    with pytest.raises(ValueError, match="no column for"):
        upload.run(spark, str(tmp_path / "m.csv"), settled(spark))


def test_alike_records_of_two_feeds_await_their_payout(spark):
    kind = "key string, source string, ref string, amount_cents long, ts long"
    rows = [("g1", "gateway", "R1", 5, 0), ("e1", "erp", "R1", 5, 9), ("g2", "gateway", "R2", 6, 0), ("g3", "gateway", "R2", 6, 0), ("g4", "gateway", "", 8, 0), ("b1", "bank", "", 9, 0)]
    pool = spark.createDataFrame(rows, kind)
    got = {r.key: (r.category, r.owner) for r in exceptions.annotate(exceptions.diagnose(pool, pool)).collect()}
    assert got == {
        "g1": ("awaiting_payout", "nobody yet — wait"), "e1": ("awaiting_payout", "nobody yet — wait"), "g2": ("duplicate", "whoever owns the feed"), "g3": ("duplicate", "whoever owns the feed"),
        "g4": ("missing_in_books", "accounts (ledger)"), "b1": ("unidentified_receipt", "treasury"),
    }


def test_five_checks(spark):
    rows = [("ok", 2, "ties_out", "arrived", 0, False), ("own", 2, "ties_out", "not_found", 0, True), ("sum", 2, "ties_out", "amount_only", 0, True), ("proved", 2, "ties_out", "arrived", 0, True),
            ("fee", 1, "ties_out", "arrived", 0, False), ("blind", 1, "ties_out", "arrived", 0, False), ("none", 0, "no_lines", "not_found", 0, False), ("books", 1, "ties_out", "arrived", 1, False)]
    report = spark.createDataFrame(rows, "settlement_id string, n_members long, tie_out string, bank string, missing_in_books long, derived boolean")
    fees = spark.createDataFrame([("fee",), ("fee",)], "settlement_id string")
    blind = spark.createDataFrame([("ok", True), ("blind", False)], "settlement_id string, agrees boolean")
    got = {r.settlement_id: (r.status, r.n_fee_findings, r.blind_solve) for r in tie_out.checks(report, fees, blind).collect()}
    assert got == {
        "ok": ("verified", 0, "agrees"), "own": ("not_verified", 0, "not_solved"), "sum": ("verified_with_findings", 0, "not_solved"), "proved": ("verified", 0, "not_solved"), "fee": ("verified_with_findings", 2, "not_solved"),
        "blind": ("not_verified", 0, "disagrees"), "none": ("no_lines", 0, "not_solved"), "books": ("verified_with_findings", 0, "not_solved"),
    }


def test_credits_by_name_and_number(spark):
    settled = spark.createDataFrame([("S-1", 100, 0, "UTR77"), ("S-2", 100, 0, "UTR88"), ("S-3", 300, 0, "UTR99"), ("S-4", 400, 0, "")], "settlement_id string, net_cents long, settled_at long, utr string")
    rows = [("utr 77", 100, "for s1", "", 5), ("B2", 100, "for S/2", "", 6), ("B3", 300, "CREDIT", "utr-99", 7), ("B4", 400, "CREDIT", None, 7), ("B5", 400, "CREDIT", None, 8)]
    credits = spark.createDataFrame(rows, "entry_id string, amount_cents long, description string, ref string, ts long")
    assert {tuple(r) for r in tie_out.settlement_credit(settled, credits).collect()} == {("S-1", "utr 77"), ("S-2", "B2"), ("S-3", "B3")}
    got = {r.settlement_id: (r.bank, r.entry_id) for r in tie_out.bank_check(settled, credits).collect()}
    assert got == {"S-1": ("arrived", "utr 77"), "S-2": ("amount_only", "B2"), "S-3": ("arrived", "B3"), "S-4": ("amount_only", "B4")}


def test_free_columns_are_judged_alone_and_without_a_shuffle_of_values(spark, monkeypatch):
    seen = []
    whole = lists.column_values
    monkeypatch.setattr(lists, "column_values", lambda raw, *a, **k: seen.append(whole(raw, *a, **k)) or seen[-1])
    raw = spark.createDataFrame([("P1", "10.00", "2024-01-05"), ("P2", "7.50", "2024-01-06")], "`Payment ID` string, Betrag string, Tag string")
    assert lists.inferred_fields(raw, ["amount", "timestamp"], ["Payment ID"]) == {"timestamp": "Tag", "amount": "Betrag"}
    assert {r["name"] for r in seen[0].collect()} == {"Betrag", "Tag"} and "n_distinct" not in seen[0].columns


def test_each_text_of_an_upload_is_parsed_once(spark):
    raw = spark.createDataFrame([("P1", "(1,234.50)", "2024-01-05T10:00:00Z", "x")], "`Payment ID` string, Amount string, Date string, _time string")
    typed = files.normalise(raw, "gateway")
    assert [(r.amount_cents, r.tz_confidence, r.error, r.extra) for r in typed.collect()] == [(-123450, "HIGH", None, {"_time": "x"})]
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("₹$€£¥") == 2 and plan.count("as timestamp") == 2  # decoration of the amount and of the text that an error quotes; with and without an offset


def test_numbers_without_a_month_or_day_are_not_parsed(spark):
    rows = [("20240229", True), ("20230229", False), ("29022024", True), ("77712345", False), ("31122023", True), ("20241301", False), ("1999", True), ("2100", False), ("00000101", None)]
    got = spark.createDataFrame(rows, "t string, want boolean").select("t", "want", refs.date_like(F.col("t")).alias("got"))
    assert all(r.got == r.want for r in got.collect() if r.want is not None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "[0-9]{4}(0[1-9]|1[0-2])" in plan

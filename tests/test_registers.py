"""List files, row identities, log markers and triage."""

import pytest
from pyspark.sql import functions as F

from remitweave.operators import audit, charges, compliance
from remitweave.sources import files


def test_party_list_reads_names_and_notes(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# Source: central list\n# retrieved: 2026-01-02\n# entries 3\n\nAcme, Ltd.\nacme ltd\n  Blue-Sky \n#Carol\n...\n")
    rows = files.party_list(spark, str(tmp_path / "list.txt")).collect()
    assert sorted(r["party"] for r in rows) == ["ACME LTD", "BLUE SKY"]
    assert {(r["source"], r["retrieved"], r["generated"], r["entries"]) for r in rows} == {("central list", "2026-01-02", None, None)}


def test_party_list_without_names_or_notes(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("# source: x\n")
    (tmp_path / "names.txt").write_text("Dora\n")
    assert files.party_list(spark, str(tmp_path / "notes.txt")).count() == 0
    assert [(r["party"], r["source"]) for r in files.party_list(spark, str(tmp_path / "names.txt")).collect()] == [("DORA", None)]


def test_uploads_are_measured_before_they_are_read(spark, tmp_path):
    (tmp_path / "small.csv").write_bytes(b"x" * 10)
    (tmp_path / "large.csv").write_bytes(b"x" * 11)
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["accepted"]) for r in files.within(spark, str(tmp_path), 10).collect()}
    assert got == {"small.csv": (10, True), "large.csv": (11, False)}


@pytest.mark.parametrize(
    ("id_column", "headers", "want"),
    [
        ("trans_id", ["trans_id", "Trans_Line_No", "seq"], "Trans_Line_No"),
        ("trans_id", ["trans_id", "seq", "line"], "line"),
        ("id", ["id", "id_seq"], "id_seq"),
        ("line", ["line", "amount"], None),
        ("trans_id", ["trans_id", "amount"], None),
    ],
)
def test_line_column(id_column, headers, want):
    assert files.line_column(id_column, headers) == want


def test_marker(spark):
    row = spark.createDataFrame([("  Ann  LEE ",)], "a string").select(audit.marker(F.col("a"), F.lit("batch_decision")).alias("m")).first()
    assert row["m"] == " [sod actor=ann lee|act=batch_decision]"


def test_triage(spark):
    rows = [("1", "DUPLICATE_TX", "auto"), ("2", "DUPLICATE_TX", "human"), ("3", "VELOCITY", "human")]
    got = compliance.triage(spark.createDataFrame(rows, "txn_id string, rule_id string, disposition string"))
    assert {tuple(r) for r in got.collect()} == {("DUPLICATE_TX", 1, 1), ("VELOCITY", 0, 1)}


def test_fees_in_both_conventions_and_silence(spark):
    rows = [(250, 45, None, None), (250, None, "9.99", "1"), (None, 7, "2.96", "0.46"), (None, None, "2.96", None), (None, None, "n/a", "1"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "f bigint, t bigint, fee string, tax string").select(charges.fee_and_tax(F.col("f"), F.col("t"), F.col("fee"), F.col("tax")).alias("x"))
    assert [tuple(r["x"]) for r in df.collect()] == [(250, 45), (250, None), (250, 46), (296, None), (None, None), (None, None)]


def test_a_settlement_of_one_rule_has_no_weights(spark):
    rows = [(1, "a", 10000, "card"), (1, "b", 10000, "wallet"), (2, "c", 10000, "card"), (2, "d", 10000, "upi"), (2, "e", -500, None), (2, "f", 10000, None), (3, "g", 10000, "netbanking"), (3, "h", 10000, None)]
    got = charges.net_weights(spark.createDataFrame(rows, "s int, txn_id string, amount_cents bigint, method string"), "s")
    assert {(r["txn_id"], r["weight_cents"]) for r in got.collect()} == {("c", 9700), ("d", 9900), ("e", -500), ("f", 9700)}

"""Header resolution by names and values, feeds with odd headers, statements of all kinds in one folder, and pending notifications."""

import itertools
import json

import pytest

from remitweave.operators import statements
from remitweave.sources import files, headers
from remitweave.streaming import notices

PROCESSOR = ["processor_transaction_id", "merchant_order_id", "settlement_batch_id", "gross_amount", "fee_amount", "net_amount", "currency", "processor_event_time", "status"]


def table(spark, names, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def test_every_column_has_one_field_and_every_field_one_column():
    found = headers.assigned(PROCESSOR)
    assert found.fields["txn_id"] == ["processor_transaction_id"] and {"merchant_order_id", "settlement_batch_id"} <= set(found.fields["ref_id"])
    assert found.fields["amount"] == ["net_amount"] and found.fields["timestamp"] == ["processor_event_time"] and found.missing == []
    assert "fee_amount" in found.barred and any(n.startswith("amount: net_amount was chosen over") for n in found.notes)
    used = [h for hs in found.fields.values() for h in hs]
    assert len(used) == len(set(used)) and all(len(hs) == 1 for t, hs in found.fields.items() if t != "ref_id")


def test_the_order_of_columns_does_not_matter():
    want = headers.assigned(PROCESSOR).fields
    for order in itertools.islice(itertools.permutations(PROCESSOR), 0, 40_320, 4_001):
        got = headers.assigned(list(order)).fields
        assert {t: sorted(hs) for t, hs in got.items()} == {t: sorted(hs) for t, hs in want.items()}


def test_sides_of_an_amount_and_value_dates():
    found = headers.assigned(["Bank Ref", "Debit", "Credit", "Value Date", "Description", "Counterparty"])
    assert set(found.fields["amount"]) == {"Debit", "Credit"} and found.fields["timestamp"] == ["Value Date"]
    assert headers.assigned(["Bank Ref", "Value Date", "Fee Amount"]).missing == ["amount"]
    assert headers.assigned(["foo", "bar", "baz"]).missing == ["amount", "timestamp", "identity"]
    assert headers.assigned(["Credit", "Value Date"]).missing == ["identity"]
    assert "2 columns are called amount" in headers.assigned(["id", "Amount", "amount", "date"]).notes


def test_likeness_of_word_sets():
    assert headers.token_set_likeness("value date", "value") == 100.0 == headers.token_set_likeness("a b", "b a")
    assert headers.token_set_likeness("transactoin id", "transaction id") > 75 and headers.token_set_likeness("colour", "status") < 50
    assert headers.token_set_likeness("", "") == 100.0 or headers.token_set_likeness("", "") == 0.0


def test_a_proposal_is_constrained():
    assert headers.constrained({"Fee Amount": "amount", "A": "amount", "B": "amount", "X": "mood", "Q": "memo"}, ["Fee Amount", "A", "B", "X"]) == {"amount": ["A"]}


def test_values_fill_in_what_names_leave_open(spark):
    raw = table(spark, ["Kennung", "Betrag", "Tag", "Wort"], [("A-1", "10.50", "2024-01-05", "for you"), ("A-2", "11.00", "2024-01-06", "and me")])
    found = headers.resolve(raw)
    assert found.missing == [] and found.by_value == {"amount": "Betrag", "timestamp": "Tag", "txn_id": "Kennung"} and len(found.notes) == 3
    rows = {r.txn_id: (r.amount_cents, str(r.ts)[:10], r.extra) for r in files.normalise(raw, "gateway").collect()}
    assert rows == {"A-1": (1050, "2024-01-05", {"Wort": "for you"}), "A-2": (1100, "2024-01-06", {"Wort": "and me"})}
    # a name that says enough isn't overruled, and a deduction isn't the amount even if nothing else is
    named = table(spark, ["id", "amount", "date", "better"], [("1", "x", "y", "10.50")])
    assert headers.resolve(named).by_value == {}
    with pytest.raises(ValueError, match="amount"):
        files.normalise(table(spark, ["Ref", "Fee Amount", "When"], [("R1", "1.50", "2024-01-05")]), "bank")


def test_debit_and_credit_of_a_row(spark):
    raw = table(spark, ["Bank Ref", "Debit", "Credit", "Value Date"], [("U1", "", "58371.62", "2024-08-14"), ("U2", "1200.00", None, "2024-08-15")])
    assert {r.txn_id: r.amount_cents for r in files.normalise(raw, "bank").collect()} == {"U1": 5_837_162, "U2": -120_000}


MT = ":20:X\n:25:1/2\n:28C:1\n:60F:C240101INR1000,00\n:61:2401020102C500,50NTRFREF1//B\n:86:PAY ONE\n:62F:C240103INR1500,50\n"
OFX = "OFXHEADER:100\n<OFX><STMTTRN><DTPOSTED>20240102<TRNAMT>7.25<FITID>F1<NAME>N</STMTTRN></BANKTRANLIST><LEDGERBAL><BALAMT>107.25</LEDGERBAL></OFX>"
TEXT = "Opening balance 10.00\n02/01/2024 SOLD 5.00 15.00\nClosing balance 15.00\n"
CAMT = "<Document xmlns='urn:iso:std:iso:20022:tech:xsd:camt.053.001.02'><BkToCstmrStmt><Bal><Cd>OPBD</Cd><Amt Ccy='INR'>1.00</Amt><CdtDbtInd>CRDT</CdtDbtInd></Bal><Ntry><Amt Ccy='INR'>2.00</Amt><CdtDbtInd>CRDT</CdtDbtInd><Sts>BOOK</Sts><BookgDt><Dt>2024-01-02</Dt></BookgDt><EndToEndId>E1</EndToEndId><Ustrd>u</Ustrd></Ntry><Bal><Cd>CLBD</Cd><Amt Ccy='INR'>3.00</Amt><CdtDbtInd>CRDT</CdtDbtInd></Bal></BkToCstmrStmt></Document>"


def test_a_mixed_folder_is_read_and_proven(spark, tmp_path):
    for name, content in {"a.sta": MT, "b.ofx": OFX, "c.txt": TEXT, "d.xml": CAMT, "e.sta": MT.replace("1500,50", "1600,50"), "empty.txt": " \n"}.items():
        (tmp_path / name).write_text(content)
    (tmp_path / "f.png").write_bytes(b"\x89PNG\r\n\x1a\n123")
    (tmp_path / "g.jpg").write_bytes(b"\xff\xd8\xff\xe0abc")
    (tmp_path / "h.pdf").write_bytes(b"%PDF-1.4 x")
    lines, proofs = statements.read(spark, str(tmp_path))
    name = lambda r: r["file"].rsplit("/", 1)[1]
    proof = {name(r): (r.kind, r.n, r.holds, r.refused) for r in proofs.collect()}
    assert proof == {
        "a.sta": ("mt940", 1, True, None),
        "b.ofx": ("ofx", 1, True, None),
        "c.txt": ("text", 1, True, None),
        "d.xml": ("camt053", 1, True, None),
        "e.sta": ("mt940", 1, False, "does not balance"),
        "empty.txt": ("text", 0, False, "no lines"),
        "f.png": ("image", 0, False, "a picture"),
        "g.jpg": ("image", 0, False, "a picture"),
        "h.pdf": ("pdf", 0, False, "a PDF"),
    }
    got = {name(r): (r.amount_cents, str(r.day), r.reference) for r in lines.collect()}
    assert got == {"a.sta": (50050, "2024-01-02", "REF1//B"), "b.ofx": (725, "2024-01-02", "F1"), "c.txt": (500, "2024-01-02", ""), "d.xml": (200, "2024-01-02", "E1"), "e.sta": (50050, "2024-01-02", "REF1//B")}
    feed = {name(r): r.amount_cents for r in statements.credits(lines, proofs.withColumnRenamed("holds", "balances")).collect()}
    assert feed == {"a.sta": 50050, "b.ofx": 725, "c.txt": 500, "d.xml": 200}


def test_pending_notices_survive_replays(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    at = lambda m: f"2024-01-01T00:{m:02d}:00Z"
    sent = [
        ("e1", "settlement.processed", "S1", 100, 1), ("e2", "settlement.processed", "S2", 200, 2), ("e3", "payment.captured", "S9", 5, 3), ("e4", "settlement.processed", " ", 5, 4),
        ("e5", "settlement.failed", "S1", 150, 9), ("e6", "settlement.processed", "S3", None, 0),
    ]
    schema = "event_id string, event string, settlement_id string, amount_cents long, currency string, received timestamp"
    for k in range(0, 6, 2):
        (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("event_id", "event", "settlement_id", "amount_cents"), e[:4])) | {"received": at(e[4])}) for e in sent[k : k + 2]))
    table = str(tmp_path / "table")
    stream = lambda: notices.announcements(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
    notices.follow(stream(), table, str(tmp_path / "c1")).awaitTermination(120)
    read = lambda: [(r.settlement_id, r.event_id, r.amount_cents, r.currency) for r in notices.pending(notices.changes(spark, table)).collect()]
    want = [("S3", "e6", 0, "INR"), ("S2", "e2", 200, "INR"), ("S1", "e5", 150, "INR")]
    assert read() == want
    notices.follow(stream(), table, str(tmp_path / "c2")).awaitTermination(120)  # all delivered once more, from the start
    assert read() == want
    done = spark.createDataFrame([("S2", 5), ("S1", 5), ("S8", 5)], "settlement_id string, m int").selectExpr("settlement_id", "timestamp'2024-01-01 00:00:00Z' + make_interval(0, 0, 0, 0, 0, m) AS at")
    for _ in range(2):
        notices.mark(spark, done, table, "r1")
        # S1 was announced again after the run
        assert read() == [("S3", "e6", 0, "INR"), ("S1", "e5", 150, "INR")]
    before = notices.state(notices.changes(spark, table)).collect()
    small = notices.compact(notices.changes(spark, table))
    assert sorted(notices.state(small).collect()) == sorted(before) and small.count() == 6

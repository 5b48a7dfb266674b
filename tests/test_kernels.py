"""Solver, record linkage, similarity, statements, files and streams against planted truth and brute force."""

import hashlib
import hmac
import itertools
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from remitweave.operators import record_linkage, similarity, statements, subset_sum
from remitweave.sources import files
from remitweave.streaming import feeds


def brute(weights, target, tolerance):
    return [c for r in range(1, len(weights) + 1) for c in itertools.combinations(range(len(weights)), r) if abs(sum(weights[k] for k in c) - target) <= tolerance]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-60, 400), min_size=1, max_size=9), st.integers(-100, 900), st.integers(0, 5))
def test_solver_counts_exactly(weights, target, tolerance):
    want = brute(weights, target, tolerance)
    outcome, members = subset_sum.solve(weights, target, tolerance)
    assert outcome == ("none" if not want else "unique" if len(want) == 1 else "ambiguous")
    assert not want or members in want


def test_greedy():
    assert subset_sum.greedy([50, 30, 40], 85) == [0, 1]


def test_match_planted(spark):
    rng, rows, truth = random.Random(7), [], {}
    for b in range(20):
        legs = [rng.randint(5_000, 400_000) for _ in range(4)]
        noise = [rng.randint(5_000, 400_000) for _ in range(10)]
        missing = b % 5 == 0
        for k, a in enumerate(legs + noise):
            if not (missing and k == 0):
                rows.append((f"B{b:02d}", f"t{k:02d}", a, k < 4, 0.8 if k < 4 else 0.1, sum(legs)))
        truth[f"B{b:02d}"] = None if missing else ",".join(f"t{k:02d}" for k in range(4))
    pool = spark.createDataFrame(rows, "settlement_id string, txn_key string, amount_cents long, anchor boolean, score double, target_cents long")
    for r in subset_sum.match(pool).collect():
        if truth[r["settlement_id"]]:
            assert r["members"] == truth[r["settlement_id"]] and r["outcome"] == "unique"
        else:
            assert r["tier"] != "anchor" or r["outcome"] == "none"


def test_em_separates_planted_matches():
    rng = np.random.default_rng(3)
    match = rng.random(2000) < 0.2
    p = np.where(match[:, None], rng.random((2000, 4)) < [0.9, 0.8, 0.95, 0.9], rng.random((2000, 4)) < [0.02, 0.2, 0.3, 0.4]).astype(int)
    patterns, counts = np.unique(p, axis=0, return_counts=True)
    share, m, u = record_linkage.fit(patterns, counts)
    assert abs(share - 0.2) < 0.05 and (m > u).all()
    weights = np.array([record_linkage.weight(x, m, u) for x in patterns])
    chosen = record_linkage.cohort(weights, counts, 350)
    assert counts[chosen].sum() >= 300 and (weights[chosen] > 0).all()
    assert record_linkage.fit(np.array([[0, 1]]), np.array([50])) is None
    assert record_linkage.fit(np.array([[1, 1]]), np.array([3])) is None


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.text("abc1", max_size=12), st.text("abc1", max_size=12))
def test_indel_ratio(a, b):
    assert similarity.indel_ratio(a, b) == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)


MT940 = """:20:X
:25:ACC
:60F:C240101INR1000,00
:61:2401020102C500,50NTRFREF1
:86:NEFT ONE
 MORE
:61:240103D100,00NTRFREF2
:86:FEE
:62F:C240103INR1400,50"""
OFX = """<OFX><BANKTRANLIST><STMTTRN><TRNAMT>500.50<DTPOSTED>20240102<FITID>REF1<NAME>NEFT<MEMO>ONE</STMTTRN>
<STMTTRN><TRNAMT>-100.00<DTPOSTED>20240103<FITID>REF2<NAME>FEE</STMTTRN></BANKTRANLIST><LEDGERBAL><BALAMT>1400.50</LEDGERBAL></OFX>"""
CAMT = """<Document xmlns="camt.053"><BkToCstmrStmt><Bal><Tp><Cd>OPBD</Cd></Tp><Amt Ccy="INR">1000.00</Amt><CdtDbtInd>CRDT</CdtDbtInd></Bal><Bal><Tp><Cd>CLBD</Cd></Tp><Amt Ccy="INR">1400.50</Amt><CdtDbtInd>CRDT</CdtDbtInd></Bal>
<Ntry><Amt Ccy="INR">500.50</Amt><CdtDbtInd>CRDT</CdtDbtInd><Sts>BOOK</Sts><BookgDt><Dt>2024-01-02</Dt></BookgDt><EndToEndId>REF1</EndToEndId><Ustrd>NEFT ONE</Ustrd></Ntry>
<Ntry><Amt Ccy="INR">9.00</Amt><CdtDbtInd>CRDT</CdtDbtInd><Sts>PDNG</Sts></Ntry>
<Ntry><Amt Ccy="INR">100.00</Amt><CdtDbtInd>DBIT</CdtDbtInd><Sts>BOOK</Sts><BookgDt><Dt>2024-01-03</Dt></BookgDt><EndToEndId>REF2</EndToEndId><Ustrd>FEE</Ustrd></Ntry></BkToCstmrStmt></Document>"""
TEXT = """Opening balance 1,000.00
02/01/2024 NEFT ONE 500.50 1,500.50
03/01/2024 FEE 100.00 1,400.50
Closing balance 1,400.50"""


@pytest.mark.parametrize(("kind", "text"), [("mt940", MT940), ("ofx", OFX), ("camt053", CAMT), ("text", TEXT)])
def test_statements(spark, kind, text):
    df = spark.createDataFrame([("good", text), ("bad", text.replace("1400.50", "1500.50").replace("1400,50", "1500,50").replace("Closing balance 1,400.50", "Closing balance 1,500.50"))], "file string, content string")
    assert {r[0] for r in df.select(statements.detect(df.content)).collect()} == {kind}
    lines = {"mt940": statements.mt940, "ofx": statements.ofx, "camt053": statements.camt053, "text": statements.text_rows}[kind](df)
    assert [r["amount_cents"] for r in lines.filter("file = 'good'").orderBy("line").collect()] == [50050, -10000]
    proof = {r["file"]: r for r in statements.verify(lines).collect()}
    assert proof["good"]["balances"] and proof["good"]["opening_cents"] == 100000 and not proof["good"]["out_of_order"]
    if kind != "ofx":  # its opening balance follows from the closing one
        assert not proof["bad"]["balances"]
        rows = statements.credits(lines, statements.verify(lines)).collect()
        assert [(r["file"], r["amount_cents"]) for r in rows] == [("good", 50050)]


def test_csv_feed(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "Payment ID,Order ID,Amount,Currency,Created At,Shelf\np1,O-1,\"₹1,234.50\",,2024-01-02T10:00:00Z,x\np2,O-2,12.5,usd,2024-01-02T10:00:00,y\np3,O-3,oops,INR,2024-01-02T10:00:00,\n"
    )
    rows = files.normalise(files.read_csv(spark, str(tmp_path / "a.csv")), "bank")
    good, bad = files.accepted(rows)
    found = {r["txn_id"]: r for r in good.collect()}
    assert found["p1"]["amount_cents"] == 123450 and found["p1"]["currency"] == "INR" and not found["p1"]["currency_stated"] and found["p1"]["extra"] == {"Shelf": "x"}
    assert found["p2"]["tz_confidence"] == "INFERRED" and str(found["p2"]["ts"]) == "2024-01-02 04:30:00" and found["p1"]["ref"] == "O1"
    assert [r["error"] for r in bad.collect()] == ["amount: not a plain amount"]
    assert files.header_map(["Transactoin ID", "Net Amount (INR)", "Value Dt", "Narrations"])["amount"] == ["Net Amount (INR)"]
    with pytest.raises(ValueError, match="no column"):
        files.header_map(["a", "b"])


def test_vouchers(spark):
    df = spark.createDataFrame([("S", "Bank", 100, 0), ("S", "Sales", 0, 100), ("T", "Bank", 5, 0)], "settlement_id string, account string, debit_cents long, credit_cents long")
    (row,) = files.vouchers(df).collect()
    assert row["settlement_id"] == "S" and "<LEDGER>Bank</LEDGER><AMOUNT>-1.00" in row["voucher"]


def test_streams(spark, tmp_path):
    sign = lambda b: hmac.new(b"k", b.encode(), hashlib.sha256).hexdigest()
    src = tmp_path / "in"
    src.mkdir()
    good = '{"event_id":"%s","settlement_id":"S","amount_cents":1,"body":"b","signature":"%s","received":"2024-01-01T00:00:00Z"}'
    (src / "a.json").write_text("\n".join([good % ("e1", sign("b")), good % ("e1", sign("b")), good % ("e2", "0")]))
    out = feeds.notifications(feeds.read_notifications(spark, str(src)), "k")
    q = out.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["event_id"] for r in spark.table("seen").collect()] == ["e1"]

    claims = tmp_path / "claims"
    claims.mkdir()
    for k, (who, key) in enumerate([("A", "p1"), ("B", "p1"), ("B", "p2")]):
        (claims / f"{k}.json").write_text(f'{{"settlement_id":"{who}","txn_key":"{key}","at":{k}}}')
        os.utime(claims / f"{k}.json", (1_000_000 + k, 1_000_000 + k))  # the order in which files arrive
    stream = spark.readStream.schema("settlement_id string, txn_key string, at long").option("maxFilesPerTrigger", 1).json(str(claims))
    feeds.record_claims(stream, str(tmp_path / "ledger"), str(tmp_path / "c2")).awaitTermination(120)
    ledger = spark.read.parquet(*[str(p) for p in (tmp_path / "ledger").glob("batch=*")])
    assert {(r["txn_key"], r["owner"]) for r in ledger.select("txn_key", "owner").collect()} == {("p1", "A"), ("p2", "B")}

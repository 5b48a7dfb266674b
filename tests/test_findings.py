"""Findings hold all rules: the SQL of each rule, brute force, and small cases."""

import difflib
import glob
import os
import random
from collections import defaultdict

import duckdb
import pytest
from test_queries import DATA

from remitweave.operators import compliance as c
from remitweave.plans import catalog
from remitweave.plans import compliance as screening
from remitweave.plans.bridge_sql import sql
from remitweave.sources import bridge

BY_RULE = {
    "STRUCTURING_PATTERN": "aml_structuring", "CTR_THRESHOLD": "aml_cash_single", "CTR_AGGREGATE": "aml_cash_aggregate", "HIGH_VELOCITY": "aml_velocity",
    "CROSS_BORDER_LIMIT": "aml_cross_border", "DORMANT_ACCOUNT_SPIKE": "aml_dormant_spike", "KEYWORD_ALERT": "aml_keywords", "LIMIT_EXCEEDED": "aml_extreme_amount",
}


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return out


def planted(query):
    return sql(screening.SQL[query].replace("FROM flow", "FROM screened"))


@pytest.fixture(scope="module")
def want(con):
    """(txn_id, rule_id) of all rules, over the flows with their planted repeats and round trips."""
    out = set()
    for rule, query in BY_RULE.items():
        rows = con.execute(planted(query))
        at = [d[0] for d in rows.description].index("first_id" if "first_id" in [d[0] for d in rows.description] else "txn_id")
        out |= {(r[at], rule) for r in rows.fetchall()}
    flow = con.execute(sql("SELECT txn_id, payer_id, payee_id, amount_cents, ts FROM screened")).fetchall()
    seen, first = set(), {}
    for r in sorted(flow):
        if r[1:] in seen:
            out.add((r[0], "DUPLICATE_TX"))
        seen.add(r[1:])
    for txn, payer, _, _, ts in flow:
        first[payer] = min(first.get(payer, (ts, txn)), (ts, txn))
    out |= {(first[r[0]][1], "CONCENTRATION_RISK") for r in con.execute(planted("aml_concentration")).fetchall()}
    out |= {(txn, rule) for _, txn, _, rule in con.execute(planted("aml_sanctions_exact")).fetchall()}
    near = lambda a, b: a != b and a[:2] == b[:2] and abs(len(a) - len(b)) <= 4 and difflib.SequenceMatcher(None, a, b).ratio() > 0.85
    close = {p for r in flow for p in r[1:3] if any(near(p, x) for x in ("U10", "U25", "M3"))}
    trips = brute_cycles([(r[0], r[1], r[2], r[4]) for r in flow], 30 * c.DAY)
    out |= {(t, "CIRCULAR_FLOW") for _, ids in trips for t in ids.split(",")}
    return out | {(r[0], "SANCTIONS_POTENTIAL_MATCH") for r in flow if close & set(r[1:3])}


def test_disposition_has_all_rules(spark, want):
    found = catalog.QUERIES["aml_disposition"](spark, DATA).collect()
    assert len(found) == len(want) and {(r["txn_id"], r["rule_id"]) for r in found} == want
    assert all((r["disposition"] == "auto") == (r["rule_id"] == "DUPLICATE_TX") == (r["open_question"] is not None) for r in found)
    why = {"SANCTIONS_HIT": "blocked", "LIMIT_EXCEEDED": "blocked", "SANCTIONS_POTENTIAL_MATCH": "statutory", "CTR_THRESHOLD": "statutory", "CTR_AGGREGATE": "statutory", "CIRCULAR_FLOW": "high_severity",
           "STRUCTURING_PATTERN": "ambiguous_pattern", "CROSS_BORDER_LIMIT": "ambiguous_pattern", "DORMANT_ACCOUNT_SPIKE": "ambiguous_pattern", "HIGH_VELOCITY": "no_rule_closes_it",
           "KEYWORD_ALERT": "no_rule_closes_it", "CONCENTRATION_RISK": "no_rule_closes_it", "DUPLICATE_TX": "data_artefact"}
    assert all(r["reason"] == why[r["rule_id"]] for r in found) and {r["reason"] for r in found} == set(why.values())
    assert {"DUPLICATE_TX", "CIRCULAR_FLOW"} <= {r["rule_id"] for r in found}


def test_review_counts_all_rules(spark, want):
    n = defaultdict(int)
    for _, rule in want:
        n[rule] += 1
    assert {r["rule_id"]: r["n"] for r in catalog.QUERIES["aml_review"](spark, DATA).collect()} == n


def test_safe_leaves_out_all_blocked(spark, con, want):
    blocked = {t for t, rule in want if rule in ("LIMIT_EXCEEDED", "SANCTIONS_HIT")}
    everyone = {t for (t,) in con.execute(sql("SELECT txn_id FROM screened")).fetchall()}
    assert {r["txn_id"] for r in catalog.QUERIES["aml_safe"](spark, DATA).collect()} == everyone - blocked


def brute_cycles(edges, hop, most=5):
    ahead, out = defaultdict(list), set()
    for e in edges:
        if e[1] != e[2]:
            ahead[e[1]].append(e)

    def walk(home, ids, met, at, last):
        for t, _, q, s in ahead[at]:
            if not last <= s <= last + hop or t in ids:
                continue
            if q == home:
                if len(ids) >= 2:
                    out.add((len(ids) + 1, ",".join(sorted([*ids, t]))))
            elif q not in met and len(ids) + 1 < most:
                walk(home, [*ids, t], {*met, q}, q, s)

    for t, p, q, s in edges:
        if p != q:
            walk(p, [t], {q}, q, s)
    return out


def test_cycles_of_five_legs(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(f"e{k}", rng.randrange(15), rng.randrange(15), rng.randrange(150 * c.DAY)) for k in range(130)]
    monkeypatch.setattr(bridge, "edges", lambda *_: spark.createDataFrame(edges, "txn_id string, payer long, payee long, ts long"))
    want = brute_cycles(edges, 30 * c.DAY)
    assert {tuple(r) for r in catalog.QUERIES["aml_circular_flow"](spark, DATA).select("legs", "txn_ids").collect()} == want
    assert {n for n, _ in want} == {3, 4, 5}


def test_small_cases(spark):
    rows = [(f"c{k}", "ABCDE"[k], "ABCDE"[(k + 1) % 5], 100, 3600 * k) for k in range(5)]
    rows += [("d1", "X", "Y", 70, 9), ("d2", "X", "Y", 70, 9), ("s1", "Evil Co", "Y", 5, 50)]
    txns = spark.createDataFrame([("gateway", *r, False, False, "") for r in rows], "source string, txn_id string, payer_id string, payee_id string, amount_cents long, ts long, is_cash boolean, is_wire boolean, memo string")
    listed = spark.createDataFrame([("EVIL-CO", False)], "name string, low_quality boolean")
    found = c.findings(txns, c.Limits(), listed=listed)
    assert {(r["txn_id"], r["rule_id"]) for r in found.collect()} == {("d2", "DUPLICATE_TX"), ("s1", "SANCTIONS_HIT"), *((f"c{k}", "CIRCULAR_FLOW") for k in range(5))}
    assert [r["txn_id"] for r in c.disposition(found).filter("disposition = 'auto'").collect()] == ["d2"]
    assert {r["txn_id"] for r in c.safe(txns, found).collect()} == {r[0] for r in rows} - {"s1"}


def test_payments_are_joined_once_for_all_lengths(spark, monkeypatch):
    rows = [("a", 1, 2, 0), ("b", 2, 3, 10), ("c", 3, 1, 20), ("d", 3, 4, 20), ("e", 4, 1, 30), ("f", 4, 5, 30), ("g", 5, 1, 40)]
    kept = []
    whole = c.written
    monkeypatch.setattr(c, "written", lambda df: kept.append(whole(df)) or kept[-1])
    found = c.cycles(spark.createDataFrame(rows, "txn_id string, payer long, payee long, ts long"), hop=100)
    assert {tuple(r) for r in found.collect()} == {(3, "a,b,c"), (4, "a,b,d,e"), (5, "a,b,d,f,g")}
    assert len(kept) == 4 and "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()

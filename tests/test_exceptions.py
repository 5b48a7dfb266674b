"""Diagnosis of unmatched rows against plain Python, and how often it moves them."""

import random

import pytest
from test_queries import DATA

from remitweave.operators import exceptions
from remitweave.plans import ledgers
from remitweave.sources import bridge

KIND = "key string, source string, ref string, amount_cents long, ts long, home string"
DAY = 86400


def plain(pool, source):
    named = [r for r in pool if r[2]]
    met = set()
    for ref, cents in {(r[2], r[3]) for r in named}:
        alike = [r for r in named if r[2:4] == (ref, cents)]
        own = sorted(r[0] for r in alike if r[1] == source)
        met |= set(own[: len(alike) - len(own)])
    out = []
    for r in pool:
        if r[1] != source or r[0] in met:
            continue
        both = [x for x in named if r[2] and x[2:4] == r[2:4]]
        near = any(x[3] == r[3] and x[1] != r[1] and abs(x[4] - r[4]) <= 3 * DAY for x in pool)
        same = sum(x[2] == r[2] for x in named)
        out.append((r[0], r[3], r[4], "duplicate" if len(both) > 1 else "partial_payment" if r[2] and same > 1 else "timing_lag" if near else "missing_entry", len(both) > 1 and len(both) == len({x[1] for x in both})))
    return sorted(out)


def drawn(seed):
    """Keys that stand twice, rows without a reference, frequent amounts, times at the edges of blocks and of the reach."""
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        home = f"R{rng.randrange(60)}"
        ts = rng.choice([0, 3, 27, 30, 33, 60]) * DAY + rng.choice([-1, 0, 0, 1])
        rows.append((f"{home}-{k % 150}", rng.choice(["gateway", "gateway", "erp", "bank"]), rng.choice(["", home, f"{home}-{k}"]), rng.randrange(12) + 100 * (k % 4), ts, home))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_reasons_are_those_of_plain_python(spark, seed):
    rows = drawn(seed)
    pool = spark.createDataFrame(rows, KIND)
    for within in ([], ["home"]):
        got = exceptions.diagnosed(pool, "gateway", within).select("key", "amount_cents", "ts", "reason", "one_each")
        assert sorted(map(tuple, got.collect())) == plain(rows, "gateway")
    left = exceptions.unmatched(pool, "gateway")
    assert sorted(map(tuple, exceptions.diagnose(left, pool).select("key", "amount_cents", "ts", "reason", "one_each").collect())) == plain(rows, "gateway")


def test_a_key_that_stands_and_lags_twice_is_not_repeated(spark):
    rows = [("a", "gateway", "", 5, 0, ""), ("a", "gateway", "", 6, 0, ""), ("b", "erp", "", 5, 9, ""), ("c", "erp", "", 6, 9, "")]
    pool = spark.createDataFrame(rows, KIND)
    got = exceptions.diagnose(exceptions.unmatched(pool, "gateway"), pool).collect()
    assert sorted((r["key"], r["amount_cents"], r["reason"]) for r in got) == [("a", 5, "timing_lag"), ("a", 6, "timing_lag")]


def test_lines_are_moved_once_and_rows_once_more(spark):
    plan = ledgers._diagnosed(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2


def test_booked_rows_are_those_of_both_feeds(spark):
    paid = bridge.gateway(spark, DATA)
    some = ["source", "txn_id", "ref", "amount_cents", "ts", "ok", "ln"]
    both = paid.select(some).unionByName(bridge.ledger(paid).select(some))
    assert sorted(map(tuple, bridge.booked(bridge.gateway(spark, DATA, by_ref=True)).select(some).collect())) == sorted(map(tuple, both.collect()))

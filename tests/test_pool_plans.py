"""A pool lies where its join left it: what is made of it moves no candidate again."""

import pytest

from remitweave.operators import linkage, review

DAY = 86400


@pytest.fixture
def pool(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    paid = [("g", str(k), f"ORD{k // 2:09d}", "payment MST01C00007" if k % 4 == 0 else "payment", 100 + k, 9 * DAY + k, 1) for k in range(8)]
    paid += [("e", str(k), f"ORD{k // 2:09d}", "sale", 100 + k, 5 * DAY, 1) for k in range(8)]  # the first moment of the window
    settled = [("MST01C00007", 10 * DAY, 1, 0, 0), ("MST01C00008", 14 * DAY, 1, 0, 0)]
    payments = spark.createDataFrame(paid, "source string, txn_id string, ref string, memo string, amount_cents long, ts long, sk long")
    yield linkage.pools(spark.createDataFrame(settled, "settlement_id string, settled_at long, sk long, net_cents long, declared_deductions long"), payments, "sk")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    """Before a run: a plan that has run lists its first form too."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def test_signals_and_feed_shuffle_a_pool_once(pool):
    rows = linkage.score(linkage.signals(pool))
    assert rows.count() == 24  # both ends of a window, which lies in two slots
    assert plan(rows).count("Exchange") == 2  # the join's sides
    feed = linkage.member_feed(rows)
    assert plan(feed).count("Exchange") == 2 and plan(feed).count("Join") == 1
    assert {r.source for r in feed.filter("settlement_id = 'MST01C00007'").collect()} == {"g"}


def test_unreferenced_reads_a_pool_once(pool):
    rows = linkage.unreferenced(linkage.anchored(pool))
    assert plan(rows).count("Exchange") == 2 and plan(rows).count("Join") == 1
    # 0 and 4 are anchored; 1 and 5, and the books' rows 0, 1, 4 and 5, share an order with them
    assert sorted(r.txn_key for r in rows.filter("settlement_id = 'MST01C00007'").collect()) == ["e:2", "e:3", "e:6", "e:7", "g:2", "g:3", "g:6", "g:7"]


def test_a_key_that_stands_twice_stays_twice(spark):
    rows = spark.createDataFrame([("S", "a", False, "ORD0001"), ("S", "a", False, "ORD0001"), ("S", "b", True, "ORD0002"), ("S", "c", False, None)], "settlement_id string, txn_key string, anchor boolean, ref string")
    assert sorted(r.txn_key for r in linkage.unreferenced(rows).collect()) == ["a", "a", "c"]


def test_siblings_are_looked_up_once(spark):
    rows = spark.createDataFrame([("S1", "a", True), ("S2", "a", False), ("S1", "b", True), ("S2", "b", True), ("S1", "c", False), ("S2", "c", False), ("S2", None, False)], "settlement_id string, txn_key string, anchor boolean")
    free = review.without_siblings(rows, rows.filter("anchor"))
    assert sorted((r.settlement_id, r.txn_key or "") for r in free.collect()) == [("S1", "a"), ("S1", "c"), ("S2", ""), ("S2", "c")]
    assert plan(free).count("Join") == 1


def test_texts_are_read_before_a_payment_is_copied_to_its_slots(spark):
    settled = spark.createDataFrame([("MST00001C00001", 864000, 100, 0, 1)], "settlement_id string, settled_at bigint, net_cents bigint, declared_deductions bigint, sk int")
    paid = spark.createDataFrame([("gateway", "P1", "ORD000000001", "payment", 100, 800000, 1)], "source string, txn_id string, ref string, memo string, amount_cents bigint, ts bigint, sk int")
    rows = linkage.pools(settled, paid, "sk")
    assert rows.select("settlement_id", "txn_key").collect() == [("MST00001C00001", "gateway:P1")]
    lines = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    copied = next(k for k, line in enumerate(lines) if "Generate explode" in line)
    read = [k for k, line in enumerate(lines) if "[A-Za-z]+|[0-9]+" in line and "_memo_tokens" in line]
    assert read and min(read) > copied

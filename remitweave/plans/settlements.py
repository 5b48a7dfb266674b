"""Settlement queries and their SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from remitweave.operators import linkage, tie_out
from remitweave.plans.bridge_sql import sql
from remitweave.sources import bridge
from remitweave.sources.shared import written


class Feeds:
    """The gateway's payments, which need a shuffle to place them, and what is derived from them. ``once``: they, the settlements and the bank's credits are
    written once for plans that read them several times, so that the order lines are scanned and shuffled once."""

    def __init__(self, spark, sf_dir, once=False):
        self._kept = written if once else lambda df: df
        self.gateway = self._kept(bridge.gateway(spark, sf_dir))
        self.ledger = bridge.ledger(self.gateway)

    @cached_property
    def settlements(self):
        return self._kept(bridge.settlements(self.gateway))

    @cached_property
    def bank(self):
        return self._kept(bridge.bank(self.settlements))

    def claims(self):
        """Each settlement claims its own payments; every eighth also the first ones of its neighbour."""
        own = self.gateway.select(F.concat(F.lit("STL"), F.lpad(F.col("ok").cast("string"), 9, "0")).alias("settlement_id"), F.concat(F.lit("gateway:"), F.col("txn_id")).alias("txn_key"), "ok", "ln")
        more = own.filter("ok % 8 = 0 AND ln = 1").withColumn("settlement_id", F.concat(F.lit("STL"), F.lpad((F.col("ok") + 1).cast("string"), 9, "0")))
        return own.unionByName(more).select("settlement_id", "txn_key")


def flagship(spark, sf_dir):
    f = Feeds(spark, sf_dir, once=True)
    return tie_out.settlement_report(f.settlements, f.gateway, f.bank, f.ledger)


def _pool(spark, sf_dir):
    f = Feeds(spark, sf_dir, once=True)
    # orders and settlements share their numbers here, so that numbers can't tell whose a payment is: plans link with ``numbers=False``
    both = f.gateway.select("source", "txn_id", "ref", "memo", "amount_cents", "ts", "ok").unionByName(f.ledger.select("source", "txn_id", "ref", "memo", "amount_cents", "ts", "ok"))
    return f, linkage.pools(f.settlements, both, "ok")


def _credit(f):
    """Some banks give the settlement's name, in a form of their own."""
    name = F.concat(F.lit(" STL-"), F.lpad(F.col("ok").cast("string"), 9, "0"))
    return tie_out.settlement_credit(f.settlements, f.bank.withColumn("description", F.when(F.col("ok") % 7 == 0, F.concat("description", name)).otherwise(F.col("description"))))


REPORT = """sums AS (SELECT ok, count(*) AS n_members, CAST(sum(amount_cents) AS BIGINT) AS gross_cents, CAST(sum(amount_cents - fee_cents - gst_cents) AS BIGINT) AS computed FROM gateway GROUP BY ok),
tie AS (SELECT s.*, coalesce(n_members, 0) AS n_members, gross_cents, computed AS computed_net_cents, coalesce(computed, 0) - net_cents AS residual_cents,
               CASE WHEN n_members IS NULL THEN 'no_lines' WHEN computed = net_cents THEN 'ties_out' ELSE 'does_not_tie_out' END AS tie_out FROM settlement s LEFT JOIN sums USING (ok)),
cand AS (SELECT settlement_id, entry_id, b.amount_cents AS credit, CASE WHEN contains(description, utr) AND b.amount_cents = net_cents THEN 0 WHEN contains(description, utr) THEN 1 ELSE 2 END AS tier
         FROM settlement s JOIN bank b ON contains(description, utr) AND b.ok = s.ok
            OR (b.amount_cents = net_cents AND NOT regexp_matches(description, 'UTR[0-9]{12}') AND abs(b.ts - settled_at) <= 604800)),
best AS (SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY tier, entry_id) AS r FROM cand),
bank_v AS (SELECT s.settlement_id, net_cents, coalesce((['arrived', 'amount_differs', 'amount_only'])[tier + 1], 'not_found') AS bank, entry_id,
                  CASE WHEN tier = 1 THEN credit - net_cents ELSE 0 END AS difference_cents FROM settlement s LEFT JOIN best b ON s.settlement_id = b.settlement_id AND r = 1),
absent AS (SELECT ok, count(*) AS missing_in_books FROM gateway g WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.txn_id = 'JV' || g.txn_id) GROUP BY ok),
report AS (SELECT t.settlement_id, n_members, t.net_cents, residual_cents, tie_out, bank, coalesce(missing_in_books, 0) AS missing_in_books,
                  CASE WHEN tie_out = 'no_lines' THEN 'no_lines' WHEN tie_out = 'does_not_tie_out' OR bank IN ('amount_differs', 'not_found') THEN 'not_verified'
                       WHEN coalesce(missing_in_books, 0) > 0 OR bank = 'amount_only' THEN 'verified_with_findings' ELSE 'verified' END AS status
           FROM tie t JOIN bank_v USING (settlement_id) LEFT JOIN absent a ON a.ok = t.ok),
claims AS (SELECT 'STL' || lpad(ok::VARCHAR, 9, '0') AS settlement_id, 'gateway:' || txn_id AS txn_key FROM gateway
           UNION ALL SELECT 'STL' || lpad((ok + 1)::VARCHAR, 9, '0'), 'gateway:' || txn_id FROM gateway WHERE ok % 8 = 0 AND ln = 1)
---"""

_POOL = """both_ AS (SELECT source, txn_id, ref, memo, amount_cents, ts, ok FROM gateway UNION ALL SELECT source, txn_id, ref, memo, amount_cents, ts, ok FROM ledger),
pool AS (SELECT s.*, source || ':' || txn_id AS txn_key, source, ref, memo, b.amount_cents, b.ts FROM settlement s JOIN both_ b ON s.ok = b.ok AND b.ts BETWEEN settled_at - 432000 AND settled_at),
"""
SIGNALS_OF = """sized AS (SELECT *, count(*) OVER (PARTITION BY settlement_id) AS n_pool FROM pool),
tok AS (SELECT settlement_id, txn_key, n_pool, unnest(list_distinct(list_filter(regexp_extract_all(upper(ref), '[A-Z]+|[0-9]+'), lambda t: len(t) >= 4))) AS token FROM sized),
shared AS (SELECT *, count(*) OVER (PARTITION BY settlement_id, token) AS n FROM tok),
clu AS (SELECT DISTINCT settlement_id, txn_key FROM shared WHERE n BETWEEN 2 AND greatest(2, least(60, n_pool // 8))),
sig AS (SELECT z.*, c.txn_key IS NOT NULL AS cluster, regexp_matches(upper(regexp_replace(memo, '[^A-Za-z0-9]', '', 'g')), z.settlement_id || '([^0-9]|$)') AS anchor,
               am.n > 1 AS amount, abs(settled_at - ts) <= 432000 AS "window"
        FROM sized z LEFT JOIN clu c USING (settlement_id, txn_key) JOIN (SELECT settlement_id, amount_cents, count(DISTINCT source) AS n FROM sized GROUP BY ALL) am USING (settlement_id, amount_cents)),
scored AS (SELECT *, round(greatest(0, least(1, anchor::INT * 0.55 + cluster::INT * 0.25 + amount::INT * 0.10 - (1 - "window"::INT) * 0.30)), 4)::DOUBLE AS score FROM sig),
placed AS (SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY anchor DESC, score DESC, txn_key) AS place FROM scored)
---"""
_SIGNALS = _POOL + SIGNALS_OF

SQL = {
    "flagship_tie_out": REPORT + "SELECT * FROM report",
    "bank_check": REPORT + "SELECT * FROM bank_v",
    "books_check": REPORT + "SELECT txn_id, ref, amount_cents FROM gateway g WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.txn_id = 'JV' || g.txn_id)",
    "report_summary": REPORT + """SELECT status, count(*) FILTER (bank = 'arrived') AS arrived, count(*) FILTER (bank = 'amount_differs') AS amount_differs,
        count(*) FILTER (bank = 'amount_only') AS amount_only, count(*) FILTER (bank = 'not_found') AS not_found FROM report GROUP BY status""",
    "settlements_from_lines": """SELECT 'STL' || lpad(ok::VARCHAR, 9, '0') AS settlement_id, CAST(sum(amount_cents - fee_cents - gst_cents) AS BIGINT) AS net_cents,
        'UTR' || lpad(ok::VARCHAR, 12, '0') AS utr, max(ts) AS settled_at FROM gateway GROUP BY ok""",
    "settlement_credit": """p AS (SELECT settlement_id, entry_id, b.ok % 7 = 0 AND b.ok = s.ok AS named FROM settlement s JOIN bank b ON net_cents = b.amount_cents AND b.ts BETWEEN settled_at AND settled_at + 86400),
        c AS (SELECT settlement_id, CASE WHEN count(*) FILTER (named) = 1 THEN min(entry_id) FILTER (named) WHEN count(*) FILTER (named) = 0 AND count(*) = 1 THEN min(entry_id) END AS entry_id FROM p GROUP BY 1)
---SELECT * FROM c WHERE entry_id IS NOT NULL""",
    "cash_position": REPORT + """SELECT bucket, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM (
        SELECT CASE WHEN pk % 97 = 0 THEN 'compliance_hold' WHEN r.settlement_id IS NOT NULL THEN 'reconciled_settled' ELSE 'gateway_in_transit' END AS bucket, amount_cents
        FROM gateway g LEFT JOIN (SELECT * FROM report WHERE status LIKE 'verified%') r ON r.settlement_id = 'STL' || lpad(g.ok::VARCHAR, 9, '0')
        UNION ALL SELECT 'deductions', declared_deductions FROM settlement WHERE settlement_id IN (SELECT settlement_id FROM report WHERE status LIKE 'verified%')
        UNION ALL SELECT 'bank_unexplained', amount_cents FROM bank WHERE 'STL' || lpad(ok::VARCHAR, 9, '0') NOT IN (SELECT settlement_id FROM report WHERE status LIKE 'verified%')) GROUP BY bucket""",
    "settlement_journal": """t AS (SELECT settlement_id, net_cents, CAST(sum(fee_cents) AS BIGINT) AS fees, CAST(sum(gst_cents) AS BIGINT) AS tax, CAST(sum(amount_cents) AS BIGINT) AS gross
        FROM settlement JOIN gateway USING (ok) GROUP BY ALL HAVING net_cents + sum(fee_cents) + sum(gst_cents) = sum(amount_cents))
---SELECT settlement_id, 'Bank' AS account, net_cents AS debit_cents, 0 AS credit_cents FROM t UNION ALL SELECT settlement_id, 'Gateway fees', fees, 0 FROM t
        UNION ALL SELECT settlement_id, 'Input GST', tax, 0 FROM t UNION ALL SELECT settlement_id, 'Gateway receivable', 0, gross FROM t""",
    "contested_payments": REPORT + """SELECT a.settlement_id AS first, b.settlement_id AS second, count(*) AS shared FROM claims a JOIN claims b ON a.txn_key = b.txn_key AND a.settlement_id < b.settlement_id GROUP BY ALL""",
    "double_claims": REPORT + """SELECT DISTINCT settlement_id FROM claims WHERE txn_key IN (SELECT txn_key FROM claims GROUP BY 1 HAVING count(DISTINCT settlement_id) > 1)""",
    "already_settled": REPORT + """SELECT settlement_id, owner, count(*) AS n FROM claims c JOIN (SELECT txn_id, 'STL' || lpad(ok::VARCHAR, 9, '0') AS owner FROM gateway WHERE ln = 1) l
        ON c.txn_key = 'gateway:' || l.txn_id WHERE owner <> settlement_id GROUP BY ALL""",
    "first_writer_ledger": REPORT + "SELECT txn_key, min(settlement_id) AS owner FROM claims GROUP BY txn_key",
    "linkage_signals": _SIGNALS + 'SELECT settlement_id, txn_key, anchor, cluster, amount, "window", score, place FROM placed WHERE anchor OR place <= 400',
    "member_feed": _SIGNALS + """SELECT settlement_id, txn_key FROM scored s LEFT JOIN (SELECT settlement_id, min(source) AS feed FROM scored WHERE anchor GROUP BY 1 HAVING count(DISTINCT source) = 1) f
        USING (settlement_id) WHERE feed IS NULL OR source = feed OR anchor""",
    "anchored_verdicts": _SIGNALS + """SELECT settlement_id, n_pool, n_anchored, anchored_cents, residual_cents, CASE WHEN ok_ THEN 'fully_anchored' ELSE 'arithmetic_only' END AS band,
        CASE WHEN ok_ THEN least(0.97, 0.95 + CASE WHEN n_pool <= 25 THEN 0.03 WHEN n_pool > 200 THEN -0.08 ELSE 0 END) ELSE 0 END::DOUBLE AS confidence, ok_ AS cleared,
        CASE WHEN NOT ok_ THEN 'no_corroborating_evidence' END AS withheld_reason
        FROM (SELECT *, anchored_cents - declared_deductions - net_cents AS residual_cents, n_anchored > 0 AND abs(anchored_cents - declared_deductions - net_cents) <= 5 AS ok_ FROM
        (SELECT settlement_id, any_value(net_cents) AS net_cents, any_value(declared_deductions) AS declared_deductions, count(*) AS n_pool, count(*) FILTER (anchor) AS n_anchored,
                CAST(sum(CASE WHEN anchor THEN amount_cents ELSE 0 END) AS BIGINT) AS anchored_cents FROM scored GROUP BY 1))""",
    "unreferenced_members": _SIGNALS.rstrip().removesuffix("---").rstrip() + """,
known AS (SELECT DISTINCT settlement_id, token FROM tok JOIN sig USING (settlement_id, txn_key) WHERE anchor),
tied AS (SELECT DISTINCT settlement_id, txn_key FROM tok SEMI JOIN known USING (settlement_id, token))
---SELECT settlement_id, txn_key FROM sig ANTI JOIN tied USING (settlement_id, txn_key) WHERE NOT anchor""",
    "substitutable_members": """SELECT g.source, g.txn_id, l.source AS twin_source, l.txn_id AS twin_id FROM gateway g JOIN ledger l ON g.ok = l.ok AND g.amount_cents = l.amount_cents""",
    "interchangeable_fifo": """p AS (SELECT txn_id, amount_cents // 1000000 AS amount_cents, currency, 'R' || (pk % 20) AS ref, ts FROM gateway),
        w AS (SELECT amount_cents, currency, ref, count(*) AS n_picked FROM p WHERE txn_id LIKE '%7' GROUP BY ALL),
        r AS (SELECT *, count(*) OVER (PARTITION BY amount_cents, currency, ref) AS n_pool, row_number() OVER (PARTITION BY amount_cents, currency, ref ORDER BY ts, txn_id) AS place FROM p)
---SELECT txn_id, n_pool, n_picked, place FROM r JOIN w USING (amount_cents, currency, ref) WHERE n_pool > n_picked AND place <= n_picked""",
}
ORACLES = {k: sql(v) for k, v in SQL.items()}


def _cash(s, d):
    f = Feeds(s, d, once=True)
    cleared = tie_out.settlement_report(f.settlements, f.gateway, f.bank, f.ledger).filter("status LIKE 'verified%'").select("settlement_id").join(f.settlements, "settlement_id").select("ok")
    return tie_out.cash_position(f.settlements, f.gateway, f.bank, cleared, f.gateway.filter("pk % 97 = 0").select("txn_id"))


def _lines(s, d):
    f = Feeds(s, d)
    return tie_out.settlements_from_lines(
        f.gateway.select(bridge.code("STL", "ok", 9).alias("settlement_id"), (F.col("amount_cents") - F.col("fee_cents") - F.col("gst_cents")).alias("net_cents"), bridge.code("UTR", "ok", 12).alias("utr"), "ts")
    )


def _settled(s, d):
    f = Feeds(s, d)
    owned = f.gateway.filter("ln = 1").select(F.col("txn_id").alias("txn_key"), bridge.code("STL", "ok", 9).alias("owner"))
    return tie_out.already_settled(f.claims(), owned)


def _first(s, d):
    f = Feeds(s, d)
    none = s.createDataFrame([], "txn_key string, owner string")
    return tie_out.first_writer(none, f.claims().withColumn("at", F.lit(0)))


def _alike(s, d):
    p = bridge.gateway(s, d).select("txn_id", F.floor(F.col("amount_cents") / 1000000).alias("amount_cents"), "currency", F.concat(F.lit("R"), (F.col("pk") % 20).cast("string")).alias("ref"), "ts")
    return linkage.interchangeable(p, p.filter("txn_id LIKE '%7'"))


def _feeds(f, once=False):
    return lambda s, d: f(Feeds(s, d, once))


def _signals(s, d):
    return linkage.score(linkage.signals(_pool(s, d)[1], numbers=False))


def _verdicts(s, d):
    f, pool = _pool(s, d)
    return linkage.anchored_verdicts(f.settlements, linkage.score(linkage.signals(pool, numbers=False)))


QUERIES = {
    "flagship_tie_out": flagship,
    "bank_check": _feeds(lambda f: tie_out.bank_check(f.settlements, f.bank), once=True),
    "books_check": _feeds(lambda f: tie_out.books_check(f.gateway, f.ledger).select("txn_id", "ref", "amount_cents")),
    "report_summary": lambda s, d: tie_out.report_summary(flagship(s, d)),
    "settlements_from_lines": _lines,
    "settlement_credit": _feeds(_credit, once=True),
    "cash_position": _cash,
    "settlement_journal": _feeds(lambda f: tie_out.journal(f.settlements, f.gateway)),
    "contested_payments": _feeds(lambda f: tie_out.contested(f.claims())),
    "double_claims": _feeds(lambda f: tie_out.double_claimed(f.claims())),
    "already_settled": _settled,
    "first_writer_ledger": _first,
    "linkage_signals": lambda s, d: linkage.capped(_signals(s, d)).select("settlement_id", "txn_key", "anchor", "cluster", "amount", "window", "score", "place"),
    "member_feed": lambda s, d: linkage.member_feed(_signals(s, d)).select("settlement_id", "txn_key"),
    "anchored_verdicts": _verdicts,
    "unreferenced_members": lambda s, d: linkage.unreferenced(linkage.anchored(_pool(s, d)[1], numbers=False)),
    "substitutable_members": _feeds(lambda f: linkage.substitutable(f.gateway, f.ledger.select("source", "txn_id", "amount_cents", "ok"))),
    "interchangeable_fifo": _alike,
}

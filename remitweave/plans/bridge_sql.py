"""The derived feeds of ``remitweave.sources.bridge`` as SQL common table expressions."""

VIEWS = """
gw0 AS (SELECT l_orderkey AS ok, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS txn_id,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents, l_partkey AS pk, l_suppkey AS sk,
               CAST(l_linenumber AS BIGINT) AS ln, l_returnflag AS flag, CAST(epoch(l_shipdate) AS BIGINT) AS shipped FROM lineitem),
gw1 AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY txn_id, amount_cents) AS place, min(shipped) OVER (PARTITION BY ok) AS start FROM gw0),
gw2 AS (SELECT *, start + least(place - 1, 7) * 21600 AS ts,
               (['card', 'upi', 'netbanking', 'wallet', 'international_card'])[CAST(pk % 5 + 1 AS INTEGER)] AS method,
               CAST(CASE pk % 5 WHEN 1 THEN 0 WHEN 2 THEN 500 WHEN 4 THEN round_even(amount_cents * 300 / 10000, 0)
                    ELSE round_even(amount_cents * 200 / 10000, 0) END + CASE WHEN pk % 17 = 0 THEN 700 ELSE 0 END AS BIGINT) AS fee_cents FROM gw1),
gateway AS (SELECT 'gateway' AS source, txn_id, 'ORD' || lpad(ok::VARCHAR, 9, '0') AS ref, amount_cents,
               CASE WHEN pk % 50 = 0 THEN 'USD' WHEN pk % 77 = 0 THEN 'AED' ELSE 'INR' END AS currency, ts,
               CASE WHEN flag = 'R' AND ln = 7 THEN 'failed' WHEN pk % 41 = 0 THEN 'On-Hold' ELSE 'captured' END AS status,
               'P' || (ok % 997) AS payer_id, 'M' || (sk % 10) AS payee_id,
               'payment STL' || lpad(ok::VARCHAR, 9, '0') || ' via ' || method AS memo, method, fee_cents,
               CAST(CASE WHEN pk % 19 = 0 THEN round_even(amount_cents * 18 / 100, 0) ELSE round_even(fee_cents * 1800 / 10000, 0) END AS BIGINT) AS gst_cents,
               ok, ln, pk FROM gw2),
ledger AS (SELECT 'erp' AS source, 'JV' || txn_id AS txn_id, ref, amount_cents, currency, ts + 3600 AS ts, 'sale ' || ref AS memo, ok, ln
           FROM gateway WHERE ln % 3 <> 0),
st0 AS (SELECT ok, CAST(sum(amount_cents) AS BIGINT) AS gross, CAST(sum(fee_cents + gst_cents) AS BIGINT) AS deductions, min(ts) AS first_ts FROM gateway GROUP BY ok),
settlement AS (SELECT 'STL' || lpad(ok::VARCHAR, 9, '0') AS settlement_id,
               gross - deductions + CASE ok % 16 WHEN 1 THEN 12345 WHEN 2 THEN 6 ELSE 0 END AS net_cents, deductions AS declared_deductions,
               first_ts + 172800 AS settled_at, 'UTR' || lpad(ok::VARCHAR, 12, '0') AS utr, ok FROM st0),
bank AS (SELECT 'BNK' || lpad(ok::VARCHAR, 9, '0') AS entry_id, net_cents - CASE WHEN ok % 13 = 0 THEN 100 ELSE 0 END AS amount_cents,
               CASE WHEN ok % 11 = 0 THEN 'NEFT CREDIT' ELSE 'NEFT CR ' || utr || ' SETTLEMENT' END AS description, settled_at + 86400 AS ts, ok
         FROM settlement WHERE ok % 10 <> 9),
flow AS (SELECT 'gateway' AS source, event_id::VARCHAR AS txn_id, 'U' || user_id AS payer_id, 'M' || (event_id % 7) AS payee_id,
               CAST(round(value * 100) AS BIGINT) AS amount_cents, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id % 3 = 0 AS is_cash, event_id % 5 = 0 AS is_wire,
               event_type AS memo FROM events),
leg AS (SELECT *, unnest([0, 1, 2]) AS leg FROM flow WHERE txn_id::BIGINT % 89 = 0),
screened AS (SELECT * FROM flow UNION ALL SELECT * REPLACE ('R' || txn_id AS txn_id) FROM flow WHERE txn_id::BIGINT % 97 = 0
             UNION ALL SELECT source, 'C-' || txn_id || '-' || leg, CASE leg WHEN 0 THEN payer_id WHEN 1 THEN 'A' || txn_id ELSE 'B' || txn_id END,
                    CASE leg WHEN 0 THEN 'A' || txn_id WHEN 1 THEN 'B' || txn_id ELSE payer_id END, amount_cents, ts + 3600 * (leg + 1), is_cash, is_wire, memo FROM leg),
edge AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS txn_id, o_custkey::BIGINT AS payer,
               l_partkey::BIGINT AS payee, CAST(epoch(l_shipdate) AS BIGINT) AS ts
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_partkey)
"""


def sql(query: str) -> str:
    """``query``: further CTEs (each ending in a comma) and a final SELECT, after the derived feeds."""
    head, _, tail = query.partition("---")
    return f"WITH {VIEWS.strip()}{',' + head if tail else ''} {tail or query}"

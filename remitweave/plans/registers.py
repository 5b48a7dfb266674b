"""Queries of lists and registers: fees as stated, chargebacks, open items, matched payments, outcomes; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from remitweave.functions import refs
from remitweave.operators import charges, compliance, exceptions, fees, learning, rates, review, tie_out
from remitweave.plans import compliance as screening
from remitweave.plans import functions, ledgers
from remitweave.plans import settlements as st
from remitweave.plans.bridge_sql import sql
from remitweave.sources import bridge, files, lists
from remitweave.streaming import notices


def _text(cents):
    return F.concat(F.expr(f"{cents} DIV 100").cast("string"), F.lit("."), F.lpad(F.expr(f"({cents}) % 100").cast("string"), 2, "0"))


def fee_conventions(s, d):
    g = bridge.gateway(s, d)
    k = F.col("ok") % 3
    own, own_tax = F.when(k == 0, F.col("fee_cents")), F.when((k == 0) & (F.col("ln") % 2 == 0), F.col("gst_cents"))
    text, tax = F.when(k == 1, _text("(fee_cents + gst_cents)")), F.when((k == 1) & (F.col("ln") % 2 == 0), _text("gst_cents"))
    return g.select("txn_id", charges.fee_and_tax(own, own_tax, text, tax).alias("f")).select("txn_id", "f.*")


def payment_methods(s, d):
    k = F.col("ok") % 4
    said = charges.stated(F.when(k == 1, "Credit-Card").otherwise(" "), F.when(k == 2, "  VPA "))
    return bridge.gateway(s, d).select("txn_id", said.alias("stated"), charges.detected(said, F.when(k == 3, "by hand").otherwise(F.col("memo"))).alias("method"))


def method_weights(s, d):
    k = F.col("ln") % 3
    g = bridge.gateway(s, d).select("ok", "txn_id", F.when(F.col("ln") == 7, -F.col("amount_cents")).otherwise(F.col("amount_cents")).alias("amount_cents"), charges.stated(F.when(k == 1, "credit"), F.when(k == 2, "bhim")).alias("method"))
    return charges.net_weights(g, "ok")


def chargebacks(s, d):
    g = bridge.gateway(s, d).filter("pk % 23 = 0").select("txn_id", "ref", "amount_cents", "ts", "pk", "ok")
    again = g.filter("pk % 46 = 0").withColumn("ts", F.col("ts") + 60).withColumn("amount_cents", F.col("amount_cents") - 1)
    known = files.reversals(charges.recorded(g.unionByName(again)))
    return charges.pending(known.select("txn_id", "ref", "amount_cents", "ts"), known.filter("ok % 3 = 0"))


def open_item_list(s, d):
    items = ledgers.open_items(s, d).withColumn("overdue", F.col("opened") < F.lit("1998-01-01").cast("date"))
    return exceptions.listed(items).select("item_id", "amount_cents", "overdue", "n_open", "n_left_out")


def matched_rows(s, d):
    f = st.Feeds(s, d, once=True)
    return review.matched_rows(f.claims(), f.gateway.select(F.concat(F.lit("gateway:"), "txn_id").alias("txn_key"), "amount_cents")).select("settlement_id", "txn_key", "amount_cents", "place")


def latest_outcomes(s, d):
    g = bridge.gateway(s, d).select(F.concat("payee_id", F.lit("-"), (F.col("ok") % 50).cast("string")).alias("batch_id"), (F.col("pk") % 100).alias("confidence"), (F.col("pk") % 2 == 0).alias("confirmed"), F.col("payer_id").alias("reviewer"), F.col("ts").alias("at"))
    return learning.latest_outcomes(g)


def raw_references(s, d):
    k = F.col("ok") % 3
    raw = F.when(k == 0, F.concat(F.lit("ord-"), F.substring("ref", 4, 9))).when(k == 1, F.concat(F.lit("ORD "), "txn_id")).otherwise(None)
    return bridge.gateway(s, d).select("txn_id", refs.as_written(raw, F.col("ref")).alias("as_written"), refs.is_identifier(F.substring("memo", F.lit(1), (11 + F.col("ok") % 3).cast("int"))).alias("identifier"))


def _day(seconds, form):
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), "Asia/Kolkata"), form)


def settlement_list(s, d):
    """A statement whose headers name neither amount nor date: debits, zeros and unreadable amounts among credits, a full balance."""
    k, ok = lambda n: F.col("ok") % n == 0, F.col("ok")
    credit = F.when(k(7), "").when(k(29), "see note").when(k(31), "0.00").otherwise(_text("net_cents"))
    raw = st.Feeds(s, d).settlements.select(
        _day(F.col("settled_at"), "dd/MM/yyyy").alias("Posted"),
        F.when(k(7), _text("net_cents")).alias("Dr"),
        credit.alias("Cr"),
        _text("(net_cents + 100000)").alias("Closing"),
        F.when(~k(3), F.col("utr")).alias("UTR"),
        ok.cast("string").alias("Line"),
    )
    return lists.settlement_list(raw).select("settlement_id", "derived", "net_cents", F.col("settled").cast("string").alias("settled"), "readable", "day_order", "proven")


def report_payments(s, d):
    """A report in rupees with Indian times; the seventh line of an order is a refund."""
    refund = F.col("ln") == 7
    raw = bridge.gateway(s, d).select(
        F.col("txn_id").alias("Entity ID"),
        F.when(refund, "refund").otherwise("payment").alias("type"),
        F.when(refund, "0").otherwise(_text("(amount_cents - fee_cents - gst_cents)")).alias("Credit"),
        F.when(refund, _text("amount_cents")).alias("Debit"),
        _text("amount_cents").alias("Amount"),
        _text("(fee_cents + gst_cents)").alias("Fee"),
        _text("gst_cents").alias("Tax"),
        F.concat(F.lit("stl_"), F.substring(bridge.code("STL", "ok", 9), 4, 9)).alias("Settlement ID"),
        _day(F.col("ts"), "dd/MM/yyyy HH:mm:ss").alias("Settled At"),
        F.when(F.col("pk") % 2 == 0, "TRUE").alias("settled"),
        F.col("method"),
    )
    return lists.payments(lists.report_items(raw)).select("txn_id", "ref", "amount_cents", "ts", "memo", "status", "gross_cents", "fee_cents", "gst_cents", "method")


def members_by_type(s, d):
    g = bridge.gateway(s, d)
    paid = F.when(F.col("pk") % 13 != 0, bridge.code("STL", "ok", 9))
    return tie_out.members_by_type(g.select(paid.alias("settlement_id"), F.when(F.col("ln") == 7, "refund").otherwise("payment").alias("type"), "amount_cents"))


def tcs_findings(s, d):
    """Every third order states no tax; of the others, some state half a per cent and some one, each line by itself."""
    g = bridge.gateway(s, d).withColumn("amount_cents", F.when(F.col("ln") == 7, -F.col("amount_cents")).otherwise(F.col("amount_cents")))
    stated = F.when(F.col("ok") % 3 != 0, F.expr("amount_cents DIV (CASE WHEN pk % 4 = 0 THEN 200 ELSE 100 END)"))
    return fees.tcs_findings(g.withColumn("ts", F.col("ts") + 840_000_000).withColumn("tcs_cents", stated), "ok")


def _declared(s, d):
    """Rates declared with each settlement: for dollars, and with every second one for dirhams."""
    day = F.to_date(F.timestamp_seconds("settled_at"))
    each = F.array(F.lit("USD"), F.when(F.col("ok") % 2 == 0, "AED"))
    return st.Feeds(s, d).settlements.select("settlement_id", F.explode(each).alias("currency"), day.alias("day"), (F.lit(80) + F.col("ok") % 7).cast("double").alias("rate")).filter("currency IS NOT NULL")


def undeclared_rates(s, d):
    g = bridge.gateway(s, d).select(bridge.code("STL", "ok", 9).alias("settlement_id"), F.lit("INR").alias("home"), "currency", (F.col("ln") != 6).alias("currency_stated"))
    return rates.undeclared(g, _declared(s, d))


def rate_gaps(s, d):
    """Against rates published every third day, for dollars only."""
    said = _declared(s, d)
    days = said.select("day").distinct().withColumn("k", F.unix_date("day")).filter("k % 3 = 0")
    published = days.select(F.lit("USD").alias("currency"), "day", (F.lit(80) + F.col("k") % 5).cast("double").alias("rate"))
    return rates.gaps(said, published).withColumn("gap", F.round("gap", 6))


def pending_notices(s, d):
    """Settlements that events announce and no later mark closes: every event in four is of another kind, every one in seven marks its user's settlement."""
    e = bridge.table(s, d, "events").withColumn("settlement_id", bridge.code("SET", "user_id", 7))
    sent = e.select(
        F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 4 == 0, "payment.captured").otherwise("settlement.processed").alias("event"), "settlement_id",
        F.round(F.col("value") * 100).cast("bigint").alias("amount_cents"), F.lit("inr").alias("currency"), F.col("ts").cast("timestamp").alias("received"),
    )
    done = notices.marks(e.filter("event_id % 7 = 0").select("settlement_id", F.col("ts").cast("timestamp").alias("at")))
    left = notices.pending(notices.announcements(sent).unionByName(done))
    return left.select("settlement_id", "event_id", "amount_cents", "currency", F.unix_micros("received").alias("received_us"))


QUERIES = {
    "pending_notices": pending_notices,
    "members_by_type": members_by_type,
    "tcs_findings": tcs_findings,
    "undeclared_rates": undeclared_rates,
    "rate_gaps": rate_gaps,
    "settlement_list": settlement_list,
    "report_payments": report_payments,
    "identity_notes": lambda s, d: lists.identity_notes(bridge.gateway(s, d), ["txn_id", "ref", "memo", "payee_id"], "ln"),
    "fee_conventions": fee_conventions,
    "payment_methods": payment_methods,
    "method_weights": method_weights,
    "fee_audit_ranked": lambda s, d: fees.ranked(fees.audit(bridge.gateway(s, d))),
    "fee_audit_summary": lambda s, d: fees.summary(fees.audit(bridge.gateway(s, d))),
    "chargebacks_pending": chargebacks,
    "open_item_list": open_item_list,
    "matched_rows": matched_rows,
    "amount_index": lambda s, d: exceptions.amount_index(bridge.gateway(s, d)),
    "latest_outcomes": latest_outcomes,
    "raw_references": raw_references,
    "aml_triage": lambda s, d: compliance.triage(screening.QUERIES["aml_disposition"](s, d)),
}
_DECLARED = """said AS (SELECT settlement_id, c AS currency, CAST(to_timestamp(settled_at) AT TIME ZONE 'UTC' AS DATE) AS day, (80 + ok % 7)::DOUBLE AS rate FROM settlement, (VALUES ('USD'), ('AED')) AS t(c) WHERE c = 'USD' OR ok % 2 = 0)"""
SQL = {
    "pending_notices": """n AS (SELECT 'SET' || lpad(user_id::VARCHAR, 7, '0') AS settlement_id, event_id, CAST(round(value * 100) AS BIGINT) AS amount_cents, epoch_us(ts) AS t FROM events),
        a AS (SELECT * FROM n WHERE event_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY settlement_id ORDER BY t DESC, event_id::VARCHAR DESC) = 1),
        m AS (SELECT settlement_id, max(t) AS marked FROM n WHERE event_id % 7 = 0 GROUP BY 1)
---SELECT settlement_id, event_id::VARCHAR AS event_id, amount_cents, 'INR' AS currency, t AS received_us FROM a LEFT JOIN m USING (settlement_id) WHERE marked IS NULL OR marked < t""",
    "members_by_type": """SELECT CASE WHEN pk % 13 <> 0 THEN 'STL' || lpad(ok::VARCHAR, 9, '0') END AS settlement_id, CASE WHEN ln = 7 THEN 'refund' ELSE 'payment' END AS type, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS value_cents FROM gateway GROUP BY 1, 2""",
    "tcs_findings": f"""p AS (SELECT ok, CASE WHEN ln = 7 THEN -amount_cents ELSE amount_cents END AS a, {functions._rate(functions._ist('ts + 840000000'), fees.TCS)} AS rate, CASE WHEN pk % 4 = 0 THEN 200 ELSE 100 END AS part FROM gateway WHERE ok % 3 <> 0),
        e AS (SELECT ok, greatest(round_even(coalesce(sum(a * rate), 0) / 10000, 0)::BIGINT, 0) AS expected_cents, CAST(sum(trunc(a / part)) AS BIGINT) AS actual_cents FROM p GROUP BY 1)
---SELECT *, expected_cents - actual_cents AS difference_cents FROM e WHERE abs(expected_cents - actual_cents) > 100""",
    "undeclared_rates": _DECLARED + """
---SELECT 'STL' || lpad(ok::VARCHAR, 9, '0') AS settlement_id, currency, count(*) AS n FROM gateway g WHERE currency <> 'INR' AND ln <> 6 AND NOT EXISTS (SELECT 1 FROM said d WHERE d.settlement_id = 'STL' || lpad(g.ok::VARCHAR, 9, '0') AND d.currency = g.currency) GROUP BY ALL""",
    "rate_gaps": _DECLARED + """, pub AS (SELECT DISTINCT 'USD' AS currency, day, (80 + (day - DATE '1970-01-01') % 5)::DOUBLE AS rate FROM said WHERE (day - DATE '1970-01-01') % 3 = 0),
        j AS (SELECT settlement_id, s.currency, s.rate, p.rate AS reference, (s.rate - p.rate) / p.rate AS gap FROM said s ASOF JOIN pub p ON s.currency = p.currency AND s.day >= p.day WHERE s.day - p.day <= 30)
---SELECT * REPLACE (round(gap, 6) AS gap) FROM j WHERE abs(gap) > 0.03""",
    "settlement_list": """l AS (SELECT *, (net_cents // 100) || '.' || lpad((net_cents % 100)::VARCHAR, 2, '0') AS t, strftime(to_timestamp(settled_at + 19800) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM settlement WHERE ok % 7 <> 0 AND (ok % 29 = 0 OR ok % 31 <> 0))
---SELECT CASE WHEN ok % 3 <> 0 THEN utr ELSE 'CREDIT-' || day || '-' || CASE WHEN ok % 29 = 0 THEN 'see note' ELSE t END END AS settlement_id, ok % 3 = 0 AS derived, CASE WHEN ok % 29 <> 0 THEN net_cents END AS net_cents, day AS settled,
        ok % 29 <> 0 AS readable, 'day' AS day_order, true AS proven FROM l""",
    "report_payments": """SELECT txn_id, 'STL' || lpad(ok::VARCHAR, 9, '0') AS ref, CASE WHEN ln = 7 THEN -amount_cents ELSE amount_cents - fee_cents - gst_cents END AS amount_cents, ts, CASE WHEN ln = 7 THEN 'refund ' ELSE 'payment ' END || method AS memo,
        CASE WHEN pk % 2 = 0 THEN 'settled' ELSE 'unsettled' END AS status, amount_cents AS gross_cents, fee_cents, gst_cents, method FROM gateway WHERE ln = 7 OR amount_cents <> fee_cents + gst_cents""",
    "identity_notes": """c AS (UNPIVOT (SELECT txn_id, ref, memo, payee_id FROM gateway) ON COLUMNS(*) INTO NAME name VALUE v),
        e AS (SELECT name, 1 - count(DISTINCT v) / count(*) AS r, avg(contains(v, ' ')::INT) > 0.4 AND avg(len(v)) > 15 AS prose FROM c GROUP BY name)
---SELECT name, prose, NOT prose AND r > 0.5 AS repeats, r > 0.1 AS split, round(r, 6) AS repeated FROM e""",
    "fee_conventions": """SELECT txn_id, CASE ok % 3 WHEN 0 THEN fee_cents WHEN 1 THEN CASE WHEN ln % 2 = 0 THEN fee_cents ELSE fee_cents + gst_cents END END AS fee_cents, CASE WHEN ok % 3 < 2 AND ln % 2 = 0 THEN gst_cents END AS gst_cents FROM gateway""",
    "payment_methods": """SELECT txn_id, CASE ok % 4 WHEN 1 THEN 'card' WHEN 2 THEN 'upi' END AS stated, CASE ok % 4 WHEN 1 THEN 'card' WHEN 2 THEN 'upi' WHEN 3 THEN 'unknown' ELSE CASE method WHEN 'international_card' THEN 'card' ELSE method END END AS method FROM gateway""",
    "method_weights": """m AS (SELECT ok, txn_id, CASE WHEN ln = 7 THEN -amount_cents ELSE amount_cents END AS a, CASE ln % 3 WHEN 1 THEN 'card' WHEN 2 THEN 'upi' END AS m FROM gateway),
        two AS (SELECT ok FROM m WHERE a > 0 AND m IS NOT NULL GROUP BY 1 HAVING count(DISTINCT m) = 2)
---SELECT ok, txn_id, CASE WHEN a <= 0 THEN a ELSE a - CASE WHEN m = 'upi' THEN 0 ELSE round_even(a * 200 / 10000, 0)::BIGINT END - round_even(a * 100 / 10000, 0)::BIGINT END AS weight_cents FROM m SEMI JOIN two USING (ok)""",
    "fee_audit_ranked": functions._AUDIT.rstrip().removesuffix(",") + "\n---SELECT * FROM audit",
    "fee_audit_summary": functions._AUDIT.rstrip().removesuffix(",") + "\n---SELECT finding, severity, count(*) AS n, CAST(sum(difference_cents) AS BIGINT) AS difference_cents FROM audit GROUP BY ALL",
    "chargebacks_pending": """SELECT 'CB-' || txn_id AS txn_id, ref, -(amount_cents - (pk % 46 = 0)::INT) AS amount_cents, ts + CASE WHEN pk % 46 = 0 THEN 60 ELSE 0 END AS ts FROM (SELECT * FROM gateway WHERE pk % 23 = 0
        QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY ts DESC, amount_cents DESC) = 1) WHERE ok % 3 <> 0""",
    "open_item_list": ledgers.OPEN + """SELECT item_id, amount_cents, opened < DATE '1998-01-01' AS overdue, (SELECT count(*) FROM item WHERE status = 'open') AS n_open, greatest((SELECT count(*) FROM item WHERE status = 'open') - 2000, 0) AS n_left_out
        FROM item WHERE status = 'open' ORDER BY overdue DESC, abs(amount_cents) DESC, item_id LIMIT 2000""",
    "matched_rows": st.REPORT + """SELECT settlement_id, txn_key, amount_cents, row_number() OVER (PARTITION BY settlement_id ORDER BY amount_cents DESC, txn_key) AS place FROM claims c JOIN gateway g ON c.txn_key = 'gateway:' || g.txn_id""",
    "amount_index": "SELECT txn_id, max(abs(amount_cents)) AS amount_cents FROM gateway GROUP BY 1",
    "latest_outcomes": """SELECT payee_id || '-' || (ok % 50) AS batch_id, pk % 100 AS confidence, pk % 2 = 0 AS confirmed, payer_id AS reviewer FROM gateway
        QUALIFY row_number() OVER (PARTITION BY payee_id || '-' || (ok % 50) ORDER BY ts DESC, payer_id DESC, pk % 100 DESC, pk % 2 = 0 DESC) = 1""",
    "raw_references": "SELECT txn_id, CASE WHEN ok % 3 = 0 THEN 'ord-' || ref[4:12] ELSE '' END AS as_written, ok % 3 <> 0 AS identifier FROM gateway",
}
ORACLES = {k: sql(v) for k, v in SQL.items()}

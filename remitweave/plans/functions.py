"""Queries of scalar functions, filters, fees and the calendar, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from remitweave.functions import money, refs, times
from remitweave.operators import fees, filters
from remitweave.plans import settlements as st
from remitweave.plans.bridge_sql import sql
from remitweave.sources import bridge


def _raw_amounts(s, d):
    g = bridge.gateway(s, d).select("txn_id", "amount_cents", "ok")
    whole = F.floor(F.col("amount_cents") / 100)
    w, t = F.floor(whole / 1000).cast("string"), F.lpad((whole % 1000).cast("string"), 3, "0")
    c = F.lpad((F.col("amount_cents") % 100).cast("string"), 2, "0")
    p = F.concat_ws(".", whole.cast("string"), c)
    k = F.col("ok") % 7
    raw = (
        F.when(k == 0, F.concat(F.lit("₹"), w, F.lit(","), t, F.lit("."), c))
        .when(k == 1, F.concat(F.lit("("), p, F.lit(")")))
        .when(k == 2, F.concat(F.lit("Rs. "), p))
        .when(k == 3, F.concat(w, F.lit("."), t, F.lit(",50")))
        .when(k == 4, F.concat(F.lit("4,2OO."), c))
        .when(k == 5, F.concat(p, F.lit("5 CR")))
        .otherwise("")
    )
    return g.withColumn("raw", raw)


def amounts(s, d):
    return _raw_amounts(s, d).select("txn_id", F.coalesce(money.amount_cents(F.col("raw")), F.lit(0)).alias("cents"), money.amount_error(F.col("raw")).alias("error"))


def rejects(s, d):
    """Rows set aside by reason, and their share."""
    rows = amounts(s, d)
    return rows.groupBy(F.coalesce("error", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def timestamps(s, d):
    g = bridge.gateway(s, d).select("txn_id", "ts", "ok")
    iso = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("ok") % 5
    raw = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+05:30"))).when(k == 4, "soon").otherwise(iso)
    source = F.when(F.col("ok") % 3 == 0, "gateway").when(F.col("ok") % 3 == 1, "bank").otherwise("other")
    return g.select("txn_id", F.coalesce(F.unix_timestamp(times.utc(raw, source)), F.lit(-1)).alias("utc_s"), times.zone_confidence(raw, source).alias("confidence"))


def texts(s, d):
    t = bridge.table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("t"))
    c = F.col("t")
    return t.select(
        "doc_id", refs.canonical(c).alias("canonical"), refs.party(c).alias("party"), refs.memo(c).alias("memo"), refs.merchant_key(c).alias("merchant"), F.array_join(F.array_sort(refs.tokens(c)), ",").alias("tokens")
    )


def identifiers(s, d):
    g = bridge.gateway(s, d)
    needle = F.concat(F.lit("STL"), F.lpad((F.col("ok") - F.col("ok") % 3).cast("string"), 9, "0"))
    return g.select("txn_id", refs.contains_identifier(refs.canonical(F.col("memo")), needle).alias("named"), refs.contains_identifier(F.lit("X1234567"), F.substring(needle, -6, 6)).alias("inside"))


def description_tokens(s, d):
    g = bridge.gateway(s, d)
    memo = F.concat_ws(" ", F.lit("paid 20240131 31122023 1999"), F.col("amount_cents").cast("string"), F.floor(F.col("amount_cents") / 100).cast("string"), F.lpad("ok", 8, "7"), F.lit("12"))
    return g.select("txn_id", F.array_join(F.array_sort(refs.description_tokens(memo, F.col("amount_cents"))), ",").alias("tokens"))


def day_order(s, d):
    o = bridge.table(s, d, "orders")
    text = F.when(F.col("o_custkey") % 3 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yy"))
    rows = o.select("o_orderkey", "o_custkey", text.alias("value"))
    order = times.day_order(rows, "value", ["o_custkey"])
    return rows.join(order, "o_custkey").select("o_orderkey", "day_order", "proven", times.parse_day(F.col("value"), F.col("day_order")).cast("string").alias("day"))


def rupees(s, d):
    return bridge.gateway(s, d).select("txn_id", money.indian(F.col("amount_cents") * F.col("ln") - 3000000).alias("shown"))


def currency(s, d):
    return filters.in_currency(bridge.gateway(s, d), F.lit("INR"), money.parse_rates(F.lit("USD=83.125,EUR=90.5"))).select("txn_id", "amount_cents", "converted")


def settling(s, d):
    return filters.settling(bridge.gateway(s, d)).select("txn_id", "status")


def window(s, d):
    f = st.Feeds(s, d)
    return filters.in_settlement_window(f.gateway, f.settlements, 1).select("settlement_id", "txn_id")


def repeats(s, d):
    coarse = bridge.gateway(s, d).select("ref", "currency", "status", "method")
    return filters.without_repeats(coarse)


def method_fees(s, d):
    return fees.per_method(bridge.gateway(s, d))


def fee_breakdown(s, d):
    f = st.Feeds(s, d)
    half = f.settlements.withColumn("declared_deductions", F.when(F.col("ok") % 2 == 0, F.col("declared_deductions")))
    return fees.fee_breakdown(half).select("settlement_id", "gross_cents", "basis", "fee_part", "tax_part")


def fee_audit(s, d):
    return fees.audit(bridge.gateway(s, d))


def fee_shortfall(s, d):
    f = st.Feeds(s, d)
    return fees.shortfall(f.settlements.withColumn("deducted_cents", F.col("declared_deductions") + (F.col("ok") % 4 == 0).cast("int") * (F.col("ok") % 200)), f.gateway)


def repeated_fees(s, d):
    return fees.repeated_fees(bridge.gateway(s, d), "ref")


def tds(s, d):
    return fees.tds(bridge.gateway(s, d).withColumn("ts", F.col("ts") + 20 * 365 * 86400), "payee_id", 50_000_000)


def tcs(s, d):
    return fees.tcs(bridge.gateway(s, d).withColumn("ts", F.col("ts") + 24 * 365 * 86400), "payee_id")


def itc(s, d):
    g = bridge.gateway(s, d).groupBy("payee_id").agg(F.sum("gst_cents").alias("deducted"), F.sum(F.when(F.col("pk") % 100 < F.col("ok") % 100, F.col("gst_cents") * 2).otherwise(0)).alias("invoiced"))
    return g.select("payee_id", fees.itc(F.col("invoiced"), F.col("deducted")).alias("i")).select("payee_id", "i.*")


def claims(s, d):
    f = st.Feeds(s, d, once=True)
    from remitweave.operators import tie_out

    return fees.claims(fees.audit(f.gateway), tie_out.bank_check(f.settlements, f.bank), tie_out.tie_out(f.settlements, f.gateway))


def calendar(s, d):
    return times.calendar(s, "2024-01-01", "2024-12-31").select(F.col("day").cast("string").alias("day"), "closed", "cum")


def due_dates(s, d):
    dim = times.calendar(s, "1990-01-01", "2010-12-31")
    rows = st.Feeds(s, d).settlements.select("settlement_id", times.ist_date(F.col("settled_at")).alias("day"), times.ist_date(F.col("settled_at") - 950400).alias("taken"))
    out = times.add_working_days(rows, "day", 2, dim, "due")
    out = times.working_days_between(out, "taken", "day", dim, "lag")
    return out.select("settlement_id", F.col("due").cast("string").alias("due"), "lag")


CAL = """cal0 AS (SELECT d::DATE AS day FROM generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY) AS t(d)),
cal1 AS (SELECT day, CASE WHEN isodow(day) = 7 THEN 'Sunday' WHEN isodow(day) = 6 AND (day(day) - 1) // 7 + 1 = 2 THEN 'second Saturday' WHEN isodow(day) = 6 AND (day(day) - 1) // 7 + 1 = 4 THEN 'fourth Saturday'
                     WHEN (month(day), day(day)) IN ((1, 26), (8, 15), (10, 2)) THEN 'national holiday' END AS closed FROM cal0),
cal AS (SELECT *, CAST(sum((closed IS NULL)::INT) OVER (ORDER BY day) AS BIGINT) AS cum FROM cal1)
---"""
_RAW = r"""raw0 AS (SELECT txn_id, amount_cents, ok % 7 AS k, (amount_cents // 100) AS w, lpad((amount_cents % 100)::VARCHAR, 2, '0') AS c FROM gateway),
amt AS (SELECT txn_id, CASE k WHEN 0 THEN amount_cents WHEN 1 THEN -amount_cents WHEN 2 THEN amount_cents WHEN 5 THEN amount_cents + 1 ELSE 0 END AS cents,
               CASE k WHEN 3 THEN 'ambiguous decimal separator' WHEN 4 THEN 'not a plain amount' WHEN 6 THEN 'empty' END AS error FROM raw0)
---"""
_EXPECTED = "CASE method WHEN 'netbanking' THEN 500 WHEN 'upi' THEN 0 WHEN 'international_card' THEN round_even(amount_cents * 300 / 10000, 0) ELSE round_even(amount_cents * 200 / 10000, 0) END::BIGINT"
_AUDIT = f"""au0 AS (SELECT *, {_EXPECTED} AS expected, round_even(amount_cents * 10 / 10000, 0)::BIGINT AS allowed, round_even(fee_cents * 1800 / 10000, 0)::BIGINT AS gst FROM gateway),
audit AS (SELECT txn_id, 'fee_overcharge' AS finding, CASE WHEN fee_cents - expected >= expected THEN 'HIGH' ELSE 'WARNING' END AS severity, fee_cents - expected AS difference_cents FROM au0 WHERE fee_cents - expected > allowed
          UNION ALL SELECT txn_id, 'fee_undercharge', 'INFO', fee_cents - expected FROM au0 WHERE fee_cents - expected < -allowed
          UNION ALL SELECT txn_id, CASE WHEN p THEN 'gst_on_principal' ELSE 'gst_mismatch' END, CASE WHEN p THEN 'HIGH' ELSE 'WARNING' END, gst_cents - gst
          FROM (SELECT *, abs(gst_cents - round_even(amount_cents * 1800 / 10000, 0)) <= 1 AS p FROM au0) WHERE abs(gst_cents - gst) > 1),
"""


def _rate(day, schedule):
    return "CASE " + " ".join(f"WHEN {day} >= DATE '{a}' THEN {r}" for a, r in reversed(schedule)) + " END"


def _ist(ts):
    return f"CAST(to_timestamp({ts}) AT TIME ZONE 'UTC' + INTERVAL '5 hours 30 minutes' AS DATE)"


SQL = {
    "normalise_amounts": _RAW + "SELECT * FROM amt",
    "rejected_rows": _RAW + "SELECT coalesce(error, 'ok') AS reason, count(*) AS n FROM amt GROUP BY 1",
    "normalise_timestamps": """SELECT txn_id, CASE WHEN ok % 5 = 4 THEN -1 WHEN ok % 5 = 0 THEN ts WHEN ok % 5 = 1 THEN ts - 19800 WHEN ok % 3 = 1 THEN ts - 19800 ELSE ts END AS utc_s,
        CASE WHEN ok % 5 = 4 THEN NULL WHEN ok % 5 < 2 THEN 'HIGH' WHEN ok % 3 < 2 THEN 'INFERRED' ELSE 'LOW' END AS confidence FROM gateway""",
    "normalise_texts": """SELECT page_id AS doc_id, upper(regexp_replace(url, '[^A-Za-z0-9]', '', 'g')) AS canonical, upper(trim(regexp_replace(url, '[^A-Za-z0-9]+', ' ', 'g'))) AS party,
        regexp_replace(lower(trim(url)), '\\s+', ' ', 'g') AS memo, substr(regexp_replace(lower(url), '[^a-z0-9_-]', '', 'g'), 1, 64) AS merchant,
        array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(upper(url), '[A-Z]+|[0-9]+'), lambda t: len(t) >= 4))), ',') AS tokens FROM pages""",
    "contains_identifier": "SELECT txn_id, ok % 3 = 0 AS named, false AS inside FROM gateway",
    "description_tokens": """SELECT txn_id, array_to_string(list_sort(list_filter(list_distinct(['20240131x', lpad(ok::VARCHAR, 8, '7')]), lambda t: t NOT LIKE '%x' AND t <> amount_cents::VARCHAR AND t <> (amount_cents // 100)::VARCHAR
        AND try_strptime(t, '%Y%m%d') IS NULL AND try_strptime(t, '%d%m%Y') IS NULL)), ',') AS tokens FROM gateway""",
    "day_order": """r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%d/%m/%y') END AS value FROM orders),
        p AS (SELECT o_custkey, max(value[1:2]::INT) > 12 AS a, max(value[4:5]::INT) > 12 AS b FROM r GROUP BY 1),
        q AS (SELECT r.*, CASE WHEN b AND NOT a THEN 'month' ELSE 'day' END AS day_order, a <> b AS proven FROM r JOIN p USING (o_custkey)),
        z AS (SELECT *, CASE WHEN value[7:]::INT < 70 THEN value[7:]::INT + 2000 WHEN value[7:]::INT < 100 THEN value[7:]::INT + 1900 ELSE value[7:]::INT END AS y, CASE day_order WHEN 'day' THEN value[1:2] ELSE value[4:5] END AS dd, CASE day_order WHEN 'day' THEN value[4:5] ELSE value[1:2] END AS mm FROM q)
---SELECT o_orderkey, day_order, proven, try_cast(y || '-' || mm || '-' || dd AS DATE)::VARCHAR AS day FROM z""",
    "format_rupees": """v AS (SELECT txn_id, amount_cents * ln - 3000000 AS c FROM gateway), w AS (SELECT *, (abs(c) // 100)::VARCHAR AS whole FROM v),
        h AS (SELECT *, CASE WHEN len(whole) > 3 THEN whole[1:len(whole) - 3] ELSE '' END AS head FROM w)
---SELECT txn_id, CASE WHEN c < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN len(head) = 0 THEN '' WHEN len(head) <= 2 THEN head || ',' WHEN len(head) <= 4 THEN head[1:len(head) - 2] || ',' || head[len(head) - 1:] || ',' ELSE head[1:len(head) - 4] || ',' || head[len(head) - 3:len(head) - 2] || ',' || head[len(head) - 1:] || ',' END
        || right(whole, 3) || '.' || lpad((abs(c) % 100)::VARCHAR, 2, '0') AS shown FROM h""",
    "currency_filter": "SELECT txn_id, CASE WHEN currency = 'USD' THEN CAST(round(CAST(amount_cents AS DECIMAL(18,4)) * 83.125, 0) AS BIGINT) ELSE amount_cents END AS amount_cents, currency = 'USD' AS converted FROM gateway WHERE currency IN ('INR', 'USD')",
    "status_filter": "SELECT txn_id, status FROM gateway WHERE status = 'captured' AND amount_cents <> 0",
    "window_filter": "SELECT settlement_id, txn_id FROM gateway JOIN settlement USING (ok) WHERE ts BETWEEN settled_at - 86400 AND settled_at",
    "exact_repeats": "SELECT DISTINCT ref, currency, status, method FROM gateway",
    "method_fees": f"SELECT method, count(*) AS n, CAST(sum({_EXPECTED}) AS BIGINT) AS expected_fee_cents, CAST(sum(round_even({_EXPECTED} * 1800 / 10000, 0)) AS BIGINT) AS expected_gst_cents FROM gateway GROUP BY 1",
    "fee_breakdown": """b AS (SELECT settlement_id, net_cents, CASE WHEN ok % 2 = 0 THEN net_cents + declared_deductions ELSE round_even(net_cents / 0.97::DOUBLE, 0)::BIGINT END AS gross_cents, CASE WHEN ok % 2 = 0 THEN 'declared' ELSE 'estimated' END AS basis FROM settlement)
---SELECT settlement_id, gross_cents, basis, least(round_even(gross_cents * 200 / 10000, 0)::BIGINT, gross_cents - net_cents) AS fee_part, gross_cents - net_cents - least(round_even(gross_cents * 200 / 10000, 0)::BIGINT, gross_cents - net_cents) AS tax_part FROM b""",
    "fee_audit": _AUDIT.rstrip().rstrip(",") + "\n---SELECT * FROM audit",
    "fee_shortfall": "SELECT settlement_id, ok % 200 AS difference_cents, CASE WHEN ok % 200 > 100 THEN 'HIGH' ELSE 'WARNING' END AS severity FROM settlement WHERE ok % 4 = 0 AND ok % 200 > 1",
    "repeated_fees": "r AS (SELECT txn_id, count(*) OVER (PARTITION BY ref, fee_cents ORDER BY ts, txn_id ROWS UNBOUNDED PRECEDING) AS times FROM gateway)\n---SELECT * FROM r WHERE times > 1",
    "tds_194o": f"""p AS (SELECT *, ts + 630720000 AS t2 FROM gateway), q AS (SELECT payee_id, amount_cents AS g, coalesce(sum(amount_cents) OVER (PARTITION BY payee_id, year({_ist('t2')} - INTERVAL 3 MONTH) ORDER BY t2, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, {_rate(_ist('t2'), fees.TDS)} AS rate FROM p),
        x AS (SELECT payee_id, rate, CAST(greatest(0, least(g, before + g - 50000000)) AS BIGINT) AS taxable FROM q)
---SELECT payee_id, CAST(sum(taxable) AS BIGINT) AS taxable_cents, CAST(sum(round_even(taxable * rate / 10000, 0)) AS BIGINT) AS tds_cents FROM x WHERE rate IS NOT NULL AND taxable > 0 GROUP BY 1""",
    "tcs_52": f"p AS (SELECT payee_id, amount_cents, {_rate(_ist('ts + 756864000'), fees.TCS)} AS rate FROM gateway)\n---SELECT payee_id, CAST(sum(round_even(amount_cents * rate / 10000, 0)) AS BIGINT) AS tcs_cents FROM p WHERE rate IS NOT NULL GROUP BY 1",
    "itc_check": """g AS (SELECT payee_id, CAST(sum(gst_cents) AS BIGINT) AS d, CAST(sum(CASE WHEN pk % 100 < ok % 100 THEN gst_cents * 2 ELSE 0 END) AS BIGINT) AS i FROM gateway GROUP BY 1)
---SELECT payee_id, CASE WHEN abs(i - d) <= 1 THEN 'matched' WHEN i > d THEN 'invoice_more' ELSE 'invoice_less' END AS verdict, least(i, d) AS claimable_cents FROM g""",
    "recovery_claims": _AUDIT + st.REPORT.rstrip().removesuffix("---").rstrip() + """
---SELECT kind, basis, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total_cents FROM (
        SELECT finding AS kind, 'estimated' AS basis, difference_cents AS cents FROM audit WHERE finding <> 'fee_undercharge' AND difference_cents > 0
        UNION ALL SELECT 'short_credit', 'stated', -difference_cents FROM bank_v WHERE difference_cents < 0
        UNION ALL SELECT 'not_received', 'stated', net_cents FROM bank_v WHERE bank = 'not_found'
        UNION ALL SELECT 'underpaid_settlement', 'stated', residual_cents FROM tie WHERE residual_cents > 0) GROUP BY ALL""",
    "calendar": CAL.format(a="2024-01-01", b="2024-12-31") + "SELECT day::VARCHAR AS day, closed, cum FROM cal",
    "due_dates": CAL.format(a="1990-01-01", b="2010-12-31").replace("---", "") .rstrip() + f""",
        r AS (SELECT settlement_id, {_ist('settled_at')} AS day, {_ist('settled_at - 950400')} AS taken FROM settlement)
---SELECT settlement_id, w.day::VARCHAR AS due, greatest(a.cum - b.cum, 0) AS lag FROM r JOIN cal a ON a.day = r.day JOIN cal b ON b.day = taken JOIN cal w ON w.cum = a.cum + 2 AND w.closed IS NULL""",
}
ORACLES = {k: sql(v) for k, v in SQL.items()}
QUERIES = {
    "normalise_amounts": amounts, "rejected_rows": rejects, "normalise_timestamps": timestamps, "normalise_texts": texts, "contains_identifier": identifiers,
    "description_tokens": description_tokens, "day_order": day_order, "format_rupees": rupees, "currency_filter": currency, "status_filter": settling,
    "window_filter": window, "exact_repeats": repeats, "method_fees": method_fees, "fee_breakdown": fee_breakdown, "fee_audit": fee_audit,
    "fee_shortfall": fee_shortfall, "repeated_fees": repeated_fees, "tds_194o": tds, "tcs_52": tcs, "itc_check": itc, "recovery_claims": claims,
    "calendar": calendar, "due_dates": due_dates,
}

"""Screening rules over payments (txn_id, source, payer_id, payee_id, amount_cents, ts seconds, flags), as windows and filters.

Window rules report the first qualifying start per payer, in order of (ts, txn_id). Thresholds are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitweave.operators import similarity
from remitweave.sources.shared import written

UNKNOWN_PAYER = "UNKNOWN_PAYER"
#: Words that raise a keyword alert.
KEYWORDS = ("bomb", "terror", "isis", "taliban", "crypto", "hawala", "donation", "bribe")
#: Rule, severity, action, basis.
RULES = (
    ("SANCTIONS_HIT", "HIGH", "BLOCKED", "statutory"),
    ("SANCTIONS_POTENTIAL_MATCH", "HIGH", "FLAGGED", "statutory"),
    ("LIMIT_EXCEEDED", "HIGH", "BLOCKED", "internal_policy"),
    ("CTR_THRESHOLD", "MEDIUM", "FLAGGED", "statutory"),
    ("CTR_AGGREGATE", "MEDIUM", "FLAGGED", "statutory"),
    ("STRUCTURING_PATTERN", "MEDIUM", "FLAGGED", "regulatory_guidance"),
    ("CIRCULAR_FLOW", "HIGH", "FLAGGED", "regulatory_guidance"),
    ("CROSS_BORDER_LIMIT", "MEDIUM", "FLAGGED", "regulatory_guidance"),
    ("DORMANT_ACCOUNT_SPIKE", "LOW", "FLAGGED", "regulatory_guidance"),
    ("HIGH_VELOCITY", "MEDIUM", "FLAGGED", "internal_policy"),
    ("KEYWORD_ALERT", "MEDIUM", "FLAGGED", "internal_policy"),
    ("CONCENTRATION_RISK", "MEDIUM", "FLAGGED", "internal_policy"),
    ("DUPLICATE_TX", "LOW", "FLAGGED", "internal_policy"),
)
#: Rules whose findings may close by themselves.
AUTO = ("DUPLICATE_TX",)
DAY = 86_400


@dataclass(frozen=True)
class Limits:
    """Minor units and seconds; the defaults are the statutory and house values."""

    structuring_below: int = 5_000_000
    structuring_total: int = 5_000_000
    structuring_count: int = 3
    structuring_span: int = DAY
    cash: int = 100_000_000
    cash_span: int = 30 * DAY
    velocity_count: int = 100
    velocity_total: int = 1_000_000_000
    velocity_span: int = 3600
    wire: int = 50_000_000
    dormant_gap: int = 90 * DAY
    dormant_amount: int = 10_000_000
    ceiling: int = 5_000_000_000
    concentration: float = 0.9


def rulebook(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, severity string, action string, basis string")


def with_payer(txns: DataFrame) -> DataFrame:
    """payer: the payer, else the reference, else UNKNOWN_PAYER."""
    ref = F.nullif(F.col("ref"), F.lit("")) if "ref" in txns.columns else F.lit(None).cast("string")
    return txns.withColumn("payer", F.coalesce(F.nullif(F.col("payer_id"), F.lit("")), ref, F.lit(UNKNOWN_PAYER)))


def _forward(txns: DataFrame, span: int, qualifies: Column) -> DataFrame:
    """Per payer, the first row whose window of ``span`` seconds from it on qualifies: n, total, start.

    Rows of one second are one start, as the frame is a range of times; rows before it by id are not in it.
    """
    ahead = Window.partitionBy("payer").orderBy("ts").rangeBetween(Window.currentRow, span)
    # the frame starts with all rows of the same second: take off those that come before this one
    peers = Window.partitionBy("payer", "ts").orderBy("txn_id").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy("payer").orderBy("ts", "txn_id")
    return (
        txns.withColumn("n", F.count(F.lit(1)).over(ahead) - F.count(F.lit(1)).over(peers))
        .withColumn("total", F.sum("amount_cents").over(ahead) - F.coalesce(F.sum("amount_cents").over(peers), F.lit(0)))
        .filter(qualifies)
        .withColumn("_r", F.row_number().over(first))
        .filter("_r = 1")
        .select("payer", F.col("ts").alias("start"), F.col("txn_id").alias("first_id"), "n", "total")
    )


def structuring(txns: DataFrame, at: Limits = Limits()) -> DataFrame:
    small = with_payer(txns).filter((F.col("amount_cents") < at.structuring_below) & (F.col("payer") != UNKNOWN_PAYER))
    return _forward(small, at.structuring_span, (F.col("n") >= at.structuring_count) & (F.col("total") >= at.structuring_total))


def cash_single(txns: DataFrame, at: Limits = Limits()) -> DataFrame:
    return with_payer(txns).filter(F.col("is_cash") & (F.col("amount_cents") >= at.cash)).select("payer", "txn_id", "amount_cents")


def cash_aggregate(txns: DataFrame, at: Limits = Limits()) -> DataFrame:
    return _forward(with_payer(txns).filter(F.col("is_cash") & (F.col("amount_cents") < at.cash)), at.cash_span, F.col("total") >= at.cash)


def velocity(txns: DataFrame, at: Limits = Limits()) -> DataFrame:
    return _forward(with_payer(txns), at.velocity_span, (F.col("n") > at.velocity_count) | (F.col("total") > at.velocity_total))


def cross_border(txns: DataFrame, at: Limits = Limits()) -> DataFrame:
    return with_payer(txns).filter(F.col("is_wire") & (F.col("amount_cents") >= at.wire)).select("payer", "txn_id", "amount_cents")


def dormant_spike(txns: DataFrame, at: Limits = Limits()) -> DataFrame:
    """Every payment of enough size that follows a long silence of its payer."""
    before = F.lag("ts").over(Window.partitionBy("payer").orderBy("ts", "txn_id"))
    gap = (F.col("ts") - before).alias("gap")
    return with_payer(txns).select("payer", "txn_id", "amount_cents", gap).filter((F.col("gap") >= at.dormant_gap) & (F.col("amount_cents") >= at.dormant_amount))


def keywords(txns: DataFrame, words: tuple[str, ...] = KEYWORDS) -> DataFrame:
    found = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("memo"), w))
    return with_payer(txns).select("payer", "txn_id", F.concat_ws(",", found).alias("words")).filter("words <> ''")


def duplicates(txns: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one of their own feed in amount, time and parties."""
    same = Window.partitionBy("source", "amount_cents", "ts", "payer_id", "payee_id").orderBy("txn_id")
    first = F.first("txn_id").over(same)
    return txns.select("source", "txn_id", first.alias("first_id"), F.row_number().over(same).alias("_r")).filter("_r > 1").drop("_r")


def concentration(txns: DataFrame, at: Limits = Limits()) -> DataFrame:
    """Payers with more than the given share of the whole volume, in more than one payment."""
    rows = with_payer(txns)
    total = rows.agg(F.sum("amount_cents").alias("volume"))  # one row
    each = rows.groupBy("payer").agg(F.sum("amount_cents").alias("total"), F.count(F.lit(1)).alias("n"))
    return (
        each.join(F.broadcast(total))
        .filter((F.col("payer") != UNKNOWN_PAYER) & (F.col("n") > 1) & (F.col("volume") != 0) & (F.col("total") > at.concentration * F.col("volume")))
        .select("payer", "n", "total", "volume")
    )


def extreme(txns: DataFrame, at: Limits = Limits()) -> DataFrame:
    return with_payer(txns).filter(F.col("amount_cents") >= at.ceiling).select("payer", "txn_id", "amount_cents")


def folded(name: Column) -> Column:
    """Letters and digits, upper case, without spaces: the form in which parties and list entries compare."""
    return F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9]", ""))


def sanctions_exact(txns: DataFrame, listed: DataFrame) -> DataFrame:
    """listed: name, low_quality. An exact hit on a low-quality alias flags; any other blocks."""
    names = listed.select(folded(F.col("name")).alias("party"), "low_quality").groupBy("party").agg(F.min("low_quality").alias("low_quality"))
    sides = txns.select("source", "txn_id", F.explode(F.array(folded(F.col("payer_id")), folded(F.col("payee_id")))).alias("party")).filter("party <> ''")
    return sides.join(names, "party").select(
        "source", "txn_id", "party", F.when(F.col("low_quality"), "SANCTIONS_POTENTIAL_MATCH").otherwise("SANCTIONS_HIT").alias("rule_id")
    ).distinct()


def concentrated(txns: DataFrame, at: Limits = Limits()) -> DataFrame:
    """The first payment of each payer that ``concentration`` reports."""
    first = Window.partitionBy("payer").orderBy("ts", "txn_id")
    rows = with_payer(txns).join(concentration(txns, at).select("payer"), "payer", "left_semi")
    return rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("txn_id")


def circular(txns: DataFrame, hop: int = DAY) -> DataFrame:
    """All payments of all cycles. Parties are compared folded."""
    edges = txns.select("txn_id", folded(F.col("payer_id")).alias("payer"), folded(F.col("payee_id")).alias("payee"), "ts")
    found = cycles(edges.filter("payer <> '' AND payee <> ''"), hop=hop)
    return found.select(F.explode(F.split("txn_ids", ",")).alias("txn_id")).distinct()


def listed_parties(txns: DataFrame, listed: DataFrame) -> DataFrame:
    """txn_id, rule_id: exact hits, and names close to a listed one, which flag only."""
    names = listed.select(folded(F.col("name")).alias("name"))
    sides = txns.select("txn_id", F.explode(F.array(folded(F.col("payer_id")), folded(F.col("payee_id")))).alias("party")).filter("party <> ''")
    near = similarity.similar_names(sides.select("party"), names).select("party").distinct()
    close = sides.join(near, "party").select("txn_id", F.lit("SANCTIONS_POTENTIAL_MATCH").alias("rule_id"))
    return sanctions_exact(txns, listed).select("txn_id", "rule_id").unionByName(close).distinct()


def findings(txns: DataFrame, at: Limits = Limits(), *, words: tuple[str, ...] = KEYWORDS, listed: DataFrame | None = None, hop: int = DAY) -> DataFrame:
    """All rules: txn_id, rule_id, severity, action, basis. A window or concentration rule reports its first payment, a cycle
    all of its payments. listed: name, low_quality; without it, the rules of listed parties are left out."""
    rules = {
        "STRUCTURING_PATTERN": structuring(txns, at).select(F.col("first_id").alias("txn_id")),
        "CTR_THRESHOLD": cash_single(txns, at).select("txn_id"),
        "CTR_AGGREGATE": cash_aggregate(txns, at).select(F.col("first_id").alias("txn_id")),
        "HIGH_VELOCITY": velocity(txns, at).select(F.col("first_id").alias("txn_id")),
        "CROSS_BORDER_LIMIT": cross_border(txns, at).select("txn_id"),
        "DORMANT_ACCOUNT_SPIKE": dormant_spike(txns, at).select("txn_id"),
        "KEYWORD_ALERT": keywords(txns, words).select("txn_id"),
        "DUPLICATE_TX": duplicates(txns).select("txn_id"),
        "LIMIT_EXCEEDED": extreme(txns, at).select("txn_id"),
        "CONCENTRATION_RISK": concentrated(txns, at),
        "CIRCULAR_FLOW": circular(txns, hop),
    }
    out = listed_parties(txns, listed) if listed is not None else None
    for rule, rows in rules.items():
        rows = rows.select("txn_id", F.lit(rule).alias("rule_id"))
        out = rows if out is None else out.unionByName(rows)
    return out.join(F.broadcast(rulebook(txns.sparkSession)), "rule_id")  # a rule book of 13 rows


def safe(txns: DataFrame, found: DataFrame) -> DataFrame:
    """Payments without a blocking finding."""
    return txns.join(found.filter("action = 'BLOCKED'").select("txn_id"), "txn_id", "left_anti")


def review(found: DataFrame, txns: DataFrame) -> DataFrame:
    """Findings by rule: payments, volume, blocking first, then severity, then volume."""
    order = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    ranked = Window.orderBy((F.col("action") != "BLOCKED").cast("int"), order, F.desc("total"), "rule_id")
    each = found.join(txns.select("txn_id", "amount_cents"), "txn_id").groupBy("rule_id", "severity", "action").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("total")
    )
    return each.withColumn("place", F.row_number().over(ranked))  # a row for each rule


def disposition(found: DataFrame) -> DataFrame:
    """Who decides each finding, and why: the first of these that holds. Only a low finding of a house rule that tells a data artefact (``AUTO``) closes by itself;
    ``open_question`` is what such a close leaves unanswered."""
    basis, severity, auto = F.lower(F.trim("basis")), F.upper(F.trim("severity")), F.trim("rule_id").isin(*AUTO)
    reason = (
        F.when(F.upper(F.trim("action")) == "BLOCKED", "blocked")
        .when(basis == "statutory", "statutory")
        .when(severity == "HIGH", "high_severity")
        .when((basis == "internal_policy") & (severity == "LOW") & auto, "data_artefact")
        .when(basis == "regulatory_guidance", "ambiguous_pattern")
        .otherwise("no_rule_closes_it")
    )
    closed = F.col("reason") == "data_artefact"
    return (
        found.withColumn("reason", reason)
        .withColumn("disposition", F.when(closed, "auto").otherwise("human"))
        .withColumn("open_question", F.when(closed, "was the customer charged twice?"))
    )


def triage(decided: DataFrame) -> DataFrame:
    """How many findings close by themselves, and how many a person decides, by rule."""
    return decided.groupBy("rule_id").agg(F.count_if(F.col("disposition") == "auto").alias("n_auto"), F.count_if(F.col("disposition") == "human").alias("n_human"))


def cycles(edges: DataFrame, *, legs: tuple[int, int] = (3, 5), hop: int = DAY) -> DataFrame:
    """Payments that return to their first payer in 3 to 5 legs through distinct parties, each hop at most ``hop`` seconds
    after the one before. edges: txn_id, payer, payee, ts. One row per set of payments: legs, txn_ids (sorted, comma-joined).

    Paths have three legs at most: longer cycles are two paths, joined on both of their ends, so that a busy party's rows don't grow with each leg."""
    both = written(edges.filter("payer <> payee").select("txn_id", "payer", "payee", "ts"))
    # a party of a cycle pays and is paid
    both = both.join(both.select(F.col("payee").alias("payer")).distinct(), "payer", "left_semi").join(both.select(F.col("payer").alias("payee")).distinct(), "payee", "left_semi")
    step = written(both.select(F.col("txn_id").alias("t"), F.col("payer").alias("p"), F.col("payee").alias("q"), F.col("ts").alias("s"), F.floor(F.col("ts") / hop).alias("slot")))

    def extended(path: DataFrame, spread: bool) -> DataFrame:
        """path: home, met (the parties after it, the last one included), at, first, last, slot, ids. Each hop lands in the slot of its predecessor or the next one: an equality that
        bounds the range join. ``spread``: the paths, as the narrower side, go to both slots; else the payments do."""
        if spread:
            path, hops = path.withColumn("slot", F.explode(F.array(F.col("slot"), F.col("slot") + 1))), step
        else:
            hops = step.withColumn("slot", F.explode(F.array(F.col("slot"), F.col("slot") - 1)))
        return (
            path.alias("a")
            .join(hops.alias("b"), (F.col("a.at") == F.col("b.p")) & (F.col("a.slot") == F.col("b.slot")))
            .filter(F.col("s").between(F.col("last"), F.col("last") + hop) & ~F.array_contains("ids", F.col("t")) & ~F.array_contains("met", F.col("q")))
            .select(
                "home", F.array_append("met", F.col("q")).alias("met"), F.col("q").alias("at"), "first", F.col("s").alias("last"), F.floor(F.col("s") / hop).alias("slot"),
                F.array_append("ids", F.col("t")).alias("ids"),
            )
        )

    def found(rows: DataFrame, ids: Column) -> DataFrame:
        return rows.select(F.size(ids).alias("legs"), F.array_join(F.array_sort(ids), ",").alias("txn_ids"))

    def closed(there: DataFrame) -> DataFrame:
        """Cycles of a path and one of two legs that leads back."""
        x, y = there.alias("x"), two.alias("y")
        back = (F.col("x.at") == F.col("y.home")) & (F.col("x.home") == F.col("y.at")) & F.col("y.first").between(F.col("x.last"), F.col("x.last") + hop)
        return found(
            x.join(y, back).filter(~F.array_contains("x.met", F.col("y.met")[0]) & ~F.arrays_overlap("x.ids", "y.ids")), F.concat("x.ids", "y.ids")
        )

    one = step.select(F.col("p").alias("home"), F.array("q").alias("met"), F.col("q").alias("at"), F.col("s").alias("first"), F.col("s").alias("last"), "slot", F.array("t").alias("ids"))
    two = written(extended(one, spread=False).filter("at <> home"))
    three = written(extended(two, spread=True))  # read for three legs and for five
    by_legs = {3: found(three.filter("at = home"), F.col("ids")), 4: closed(two), 5: closed(three.filter("at <> home"))}
    out = None
    for n in range(legs[0], legs[1] + 1):
        out = by_legs[n] if out is None else out.unionByName(by_legs[n])
    return out.distinct()

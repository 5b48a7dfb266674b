"""Which payments belong to which settlement, and how sure that is: signals, scores, bands and gates as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitweave.functions import refs

#: Weights of the signals, the penalty outside the window, lengths and bounds.
WEIGHTS = {"anchor": 0.55, "cluster": 0.25, "named": 0.15, "amount": 0.10}
PENALTY = 0.30
MIN_TOKEN, MIN_ANCHOR, MAX_CANDIDATES, CLUSTER_CAP = 4, 6, 400, 60
BAND_BASE = {"fully_anchored": 0.95, "anchors_all_used": 0.88, "named_complete": 0.88, "learned_cycle": 0.80}
GATE, OPEN_POOL = 0.85, 20


def txn_key(source: Column, txn_id: Column) -> Column:
    return F.concat_ws(":", source, txn_id)


def in_window(ts: Column, settled: Column, days: int = 5) -> Column:
    """One-sided, both ends included."""
    return ts.between(settled - days * 86400, settled)


def by_pool(rows: DataFrame) -> list[str]:
    """What the rows of one settlement lie by: its group and slot, where ``pools`` left them, so that nothing is shuffled again."""
    return [c for c in ("_group", "_slot") if c in rows.columns] + ["settlement_id"]


def pools(settlements: DataFrame, payments: DataFrame, group: str, days: int = 5, width: int = 1, around: bool = False) -> DataFrame:
    """Candidates of each settlement: the payments of its group (merchant, account) in its window. A settlement stands once.

    Time is cut into slots of ``width`` windows, so that a window lies in two of them at most and the join is an equality on group and slot: a busy
    merchant's payments are spread over its slots and meet only the settlements of their time. A payment goes to its own slot and, if a window from it ends there, the next, and a
    settlement to its own alone, so that a pool lies in one place (``by_pool``) and isn't shuffled after the join; wider slots copy fewer payments. What is read from a text is
    read before it, once for each payment. ``around``: settlements also go where their payments' other copies are, so that a payment meets all its settlements wherever it lies;
    ``_home`` is true where the pool is (``siblings``).
    """
    span = days * 86400
    slot = lambda at: F.floor(at / (span * width))
    settled = F.col("settled_at")
    left = settlements.withColumns({"_group": F.col(group), "_slot": slot(settled), **_of_settlement()})
    if around:
        left = left.withColumn("_at", F.col("_slot")).withColumn("_slot", F.explode(F.array_distinct(F.array(slot(settled - span), "_slot", slot(settled + span)))))
        # a broadcast join would leave the rows where they are read, and the windows by payment and by pool would each move them
        left = left.withColumn("_home", F.col("_at") == F.col("_slot")).drop("_at").hint("merge")
    read = payments.select(
        F.col(group).alias("_g"), F.array_distinct(F.array(slot(F.col("ts")), slot(F.col("ts") + span))).alias("_slots"), txn_key(F.col("source"), F.col("txn_id")).alias("txn_key"), "source", "ref", "memo",
        "amount_cents", "ts", *[c.alias(name) for name, c in _of_payment().items()],
    )
    # in a select of its own: beside an explode, columns are made after it, for each copy of a row
    right = read.select("*", F.explode("_slots").alias("_s")).drop("_slots")
    return left.join(right, (F.col("_group") == F.col("_g")) & (F.col("_slot") == F.col("_s")) & in_window(F.col("ts"), F.col("settled_at"), days)).drop("_g", "_s")


def _of_settlement() -> dict[str, Column]:
    return {"_needle": refs.canonical(F.col("settlement_id")), "_own": F.filter(refs.tokens(F.col("settlement_id")), refs.is_identifier)}


def _of_payment() -> dict[str, Column]:
    return {
        "_ref": refs.canonical(F.col("ref")),
        "_memo": refs.canonical(F.col("memo")),
        "_ref_tokens": refs.tokens(F.col("ref")),
        "_memo_tokens": refs.description_tokens(F.col("memo"), F.col("amount_cents")),
    }


def _read(pool: DataFrame) -> DataFrame:
    return pool.withColumns({k: c for k, c in (_of_settlement() | _of_payment()).items() if k not in pool.columns})


def _anchor(numbers: bool) -> Column:
    anchor = refs.contains_identifier(F.col("_ref"), F.col("_needle")) | refs.contains_identifier(F.col("_memo"), F.col("_needle"))
    return anchor | F.coalesce(F.arrays_overlap("_ref_tokens", "_own"), F.lit(False)) if numbers else anchor


def anchored(pool: DataFrame, numbers: bool = True) -> DataFrame:
    """The candidates with the one signal that a row has by itself: ``anchor``."""
    rows = _read(pool)
    kept = [c for c in rows.columns if c in by_pool(rows) or c not in (*_of_settlement(), *_of_payment())]
    return rows.select(*kept, _anchor(numbers).alias("anchor"))


def siblings(pool: DataFrame, numbers: bool = True) -> DataFrame:
    """The candidates of pools made ``around`` with ``anchor`` and ``foreign``: another settlement anchors the payment (as ``review.without_siblings``, without moving one).
    A key is a payment of one group and time; texts are left out, what was read from them stays for ``signals``."""
    each = Window.partitionBy("_group", "_slot", "txn_key")
    rows = pool.withColumn("anchor", _anchor(numbers)).drop("memo", "_ref", "_memo", "_needle")
    mine = F.when(F.col("anchor"), F.col("settlement_id"))
    other = lambda c: F.coalesce(c != F.col("settlement_id"), F.lit(False))
    rows = rows.withColumns({"_lo": F.min(mine).over(each), "_hi": F.max(mine).over(each)})
    return rows.withColumn("foreign", other(F.col("_lo")) | other(F.col("_hi"))).filter("_home").drop("_lo", "_hi", "_home")


def signals(pool: DataFrame, numbers: bool = True) -> DataFrame:
    """anchor, cluster, named, amount and window signals of each candidate (settlement_id, txn_key, source, ref, memo, amount_cents, ts, settled_at).

    A cluster is a token that between 2 and max(2, min(60, n / 8)) candidates of the pool share; longer lists are
    boilerplate. They are counted, never paired. With ``numbers``, identifier tokens take part: one of the settlement's own in a reference anchors, numbers
    of descriptions cluster, and a candidate whose cluster is one of the settlement's tokens is *named*. All windows
    are by settlement, so that a pool is shuffled once, and a candidate's columns go with the first of its tokens only.
    """
    known = "anchor" in pool.columns  # by ``siblings``
    rows = pool if known else _read(pool)
    by = by_pool(rows)
    tokens = F.array_union("_ref_tokens", "_memo_tokens") if numbers else F.col("_ref_tokens")
    carried = [c for c in pool.columns if c not in (*by, *_of_settlement(), *_of_payment(), "anchor")]
    rows = rows.withColumns({"_tokens": tokens, "_names": F.col("_own")})
    rows = rows if known else anchored(rows, numbers)
    # by amount first: its order serves the whole pool's count as well
    rows = rows.withColumn("amount", F.min("source").over(Window.partitionBy(*by, "amount_cents")) != F.max("source").over(Window.partitionBy(*by, "amount_cents")))
    rows = rows.withColumn("n_pool", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # a key that stands twice is two rows
    each = rows.select(*by, "n_pool", "_names", "_row", F.struct(*carried, "amount", "anchor").alias("_all"), F.posexplode_outer("_tokens").alias("_at", "_token"))
    mine = F.coalesce(F.array_contains("_names", F.col("_token")), F.lit(False)) if numbers else F.lit(False)
    each = each.select(*by, "n_pool", "_row", "_at", "_token", mine.alias("_mine"), F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_all")).alias("_all"))
    bound = F.greatest(F.lit(2), F.least(F.lit(CLUSTER_CAP), F.floor(F.col("n_pool") / 8)))
    shared = F.count("_token").over(Window.partitionBy(*by, "_token"))
    each = each.withColumn("_shared", shared).withColumn("_clustered", F.coalesce((F.col("_shared") >= 2) & (F.col("_shared") <= bound), F.lit(False)))
    of_row = Window.partitionBy(*by, "_row")
    each = each.withColumns({"cluster": F.max("_clustered").over(of_row), "named": F.max(F.col("_clustered") & F.col("_mine")).over(of_row)}).filter("_all IS NOT NULL")
    window = F.abs(F.col("settled_at") - F.col("ts")) <= 5 * 86400
    return each.select(*by, "_all.*", "n_pool", "cluster", "named").withColumn("window", window)


def score(rows: DataFrame) -> DataFrame:
    total = sum((F.when(F.col(k), F.lit(w)).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0)) - F.when(F.col("window"), 0.0).otherwise(PENALTY)
    return rows.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4))


def capped(rows: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """All anchored candidates and the best of the others, ``most`` together; equal scores in order of the learned posterior, if there is one.
    ``truncated``: others were left out, so that the solver must not call a set of this pool the only one."""
    ties = [F.desc("posterior")] if "posterior" in rows.columns else []
    pool = Window.partitionBy(*by_pool(rows))
    order = pool.orderBy(F.desc("anchor"), F.desc("score"), *ties, "txn_key")
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("truncated", F.col("n_pool") > F.greatest(F.lit(most), F.count_if("anchor").over(pool)))
    return placed.filter(F.col("anchor") | (F.col("place") <= most))


def member_feed(rows: DataFrame) -> DataFrame:
    """Members come from one feed: the one that the settlement declares (``declared_feed``, if there is such a column), else the only one that
    its anchored candidates come from, else, without any of these, the only one of its named ones. Others go unless anchored; where it is declared, they go in any case."""
    pool = Window.partitionBy(*by_pool(rows))
    named = "named" if "named" in rows.columns else "anchor"
    lo, hi = (lambda flag, end=end: end(F.when(F.col(flag), F.col("source"))).over(pool) for end in (F.min, F.max))
    sided = rows.withColumns({"_a": lo("anchor"), "_b": hi("anchor"), "_m": lo(named), "_n": hi(named), "_any": F.max("anchor").over(pool)})
    inferred = F.coalesce(F.when(F.col("_a") == F.col("_b"), F.col("_a")), F.when(~F.col("_any") & (F.col("_m") == F.col("_n")), F.col("_m")))
    declared = F.col("declared_feed") if "declared_feed" in rows.columns else F.lit(None).cast("string")
    joined = sided.withColumn("feed", F.coalesce(declared, inferred)).drop("_a", "_b", "_m", "_n", "_any")
    kept = F.col("feed").isNull() | (F.col("source") == F.col("feed")) | (F.col("anchor") & declared.isNull())
    return joined.filter(kept)


def link_points(score: Column) -> Column:
    """A score, which has four decimals, as a whole number: a mean of these doesn't depend on the order that they are added in, which at a bound decides a band."""
    return F.round(score * 10000).cast("bigint")


def band(n_anchored: Column, n_matched: Column, n_matched_anchored: Column, n_named: Column, n_matched_named: Column, n_learned_matched: Column, n_learned: Column, mean_link: Column) -> Column:
    """How a matched set stands to the anchored, named and learned sets; the first that fits."""
    return (
        F.when((n_anchored > 0) & (n_matched_anchored == n_matched), "fully_anchored")
        .when((n_named > 0) & (n_matched >= 2) & (n_matched_named == n_matched) & (n_named == n_matched) & (n_matched_anchored == n_anchored), "named_complete")
        .when((n_anchored > 0) & (n_matched_anchored == n_anchored), "anchors_all_used")
        .when(n_matched_anchored > 0, "anchors_ignored")
        .when((n_learned > 0) & (n_learned_matched == n_matched), "learned_cycle")
        .when(mean_link >= 0.4, "clustered")
        .otherwise("arithmetic_only")
    )


def confidence(band_: Column, n_pool: Column) -> Column:
    base = F.lit(0.0)
    for name, value in BAND_BASE.items():
        base = F.when(band_ == name, value).otherwise(base)
    adjusted = F.least(F.lit(0.97), base + F.when(n_pool <= 25, 0.03).when(n_pool > 200, -0.08).otherwise(0.0))
    return F.round(F.when((base == 0) | (band_ == "named_complete"), base).otherwise(adjusted), 3)


def anchored_verdicts(settlements: DataFrame, rows: DataFrame, tolerance: int = 5) -> DataFrame:
    """The tier that needs no search: the anchored candidates' sum against gross. One aggregate per settlement."""
    sums = rows.groupBy("settlement_id").agg(
        F.count(F.lit(1)).alias("n_pool"),
        F.count_if("anchor").alias("n_anchored"),
        F.sum(F.when(F.col("anchor"), F.col("amount_cents")).otherwise(0)).alias("anchored_cents"),
    )
    residual = F.col("anchored_cents") - F.col("declared_deductions") - F.col("net_cents")
    exact = (F.col("n_anchored") > 0) & (F.abs(residual) <= tolerance)
    none = F.lit(0)
    n = F.when(exact, F.col("n_anchored")).otherwise(0)
    how = band(F.col("n_anchored"), n, n, none, none, none, none, F.lit(0.0))
    return (
        settlements.join(sums, "settlement_id")
        .withColumn("residual_cents", residual)
        .withColumn("band", F.when(exact, how).otherwise("arithmetic_only"))
        .withColumn("confidence", confidence(F.col("band"), F.col("n_pool")))
        .withColumn("cleared", exact & (F.col("confidence") >= GATE))
        .withColumn("withheld_reason", F.when(F.col("cleared"), None).when(exact, "below_confidence_gate").otherwise("no_corroborating_evidence"))
        .select("settlement_id", "n_pool", "n_anchored", "anchored_cents", "residual_cents", "band", "confidence", "cleared", "withheld_reason")
    )


def verdicts(rows: DataFrame, found: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """What may clear: a solver's result (``subset_sum.match``) for the candidates ``rows`` (settlement_id, txn_key, anchor, score; if known, named and learned), banded by
    how its members stand to the anchored, named and learned ones, and gated. The named ones are those of the ``window``, if it is given. Members are looked up by key; no settlement's candidates are gathered. With ``window``, the
    whole pools, sets with a substitutable member are withheld (``substituted``); with the candidates' source, ref and amount_cents, also sets that count a payment in two feeds."""
    for flag in {"named", "learned"} - set(rows.columns):
        rows = rows.withColumn(flag, F.lit(False))
    sizes = rows.groupBy("settlement_id").agg(F.count(F.lit(1)).alias("n_pool"), F.count_if("anchor").alias("n_anchored"), F.count_if("learned").alias("n_learned"))
    all_named = (window if window is not None and "named" in window.columns else rows).groupBy("settlement_id").agg(F.count_if("named").alias("n_named"))
    members = found.filter("n_members > 0").select("settlement_id", F.explode(F.split("members", ",")).alias("txn_key"))
    flags = ["settlement_id", "txn_key", "anchor", "named", "learned", "score"]
    stand = members.join(rows.select(*flags).dropDuplicates(["settlement_id", "txn_key"]), ["settlement_id", "txn_key"]).groupBy("settlement_id").agg(
        *[F.count_if(f).alias(f"n_matched_{f}") for f in ("anchor", "named", "learned")], (F.sum(link_points(F.col("score"))) / F.count("score") / 10000).alias("mean_link")
    )
    twins = substituted(members, rows, window) if window is not None else members.select("settlement_id").limit(0)
    doubled = counted_twice(members, rows) if {"source", "ref", "amount_cents"} <= set(rows.columns) else members.select("settlement_id").limit(0)
    return gated(
        found.join(sizes, "settlement_id")
        .join(all_named, "settlement_id", "left")
        .join(stand, "settlement_id", "left")
        .join(twins.withColumn("twin", F.lit(True)), "settlement_id", "left")
        .join(doubled.withColumn("doubled", F.lit(True)), "settlement_id", "left")
    )


VERDICT = ["settlement_id", "n_pool", "n_anchored", "tier", "outcome", "n_members", "members", "residual_cents", "band", "confidence", "cleared", "withheld_reason"]


def gated(counted: DataFrame, *kept: str) -> DataFrame:
    """Bands and gates of solved settlements from their counts (``verdicts``); ``twin`` and ``doubled`` are true or null. The columns ``kept`` stay beside the verdict."""
    n = lambda c: F.coalesce(c, F.lit(0))
    how = band(
        F.col("n_anchored"), F.col("n_members"), n("n_matched_anchor"), n("n_named"), n("n_matched_named"), n("n_matched_learned"), F.col("n_learned"), F.coalesce("mean_link", F.lit(0.0))
    )
    unique = F.col("outcome") == "unique"
    reason = F.when(F.col("cleared"), None).when(~unique, F.col("outcome")).when(F.col("doubled"), "counted_twice").when(F.col("twin"), "substitutable").when(F.col("structural") == 0, "no_corroborating_evidence").otherwise("below_confidence_gate")
    return (
        counted.withColumn("band", F.when(unique, how).otherwise("arithmetic_only"))
        .withColumn("structural", confidence(F.col("band"), F.col("n_pool")))
        .withColumn("confidence", F.round(F.least("confidence", "structural"), 3))
        .withColumn("cleared", unique & (F.col("confidence") >= GATE) & F.col("twin").isNull() & F.col("doubled").isNull())
        .withColumn("withheld_reason", reason)
        .select(*VERDICT, *kept)
    )


def counted_twice(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Settlements whose set holds one reference and amount from two feeds: a payment and its copy in the books."""
    known = rows.select("settlement_id", "txn_key", "source", "ref", "amount_cents").filter("ref <> ''")
    feeds = members.join(known, ["settlement_id", "txn_key"]).groupBy("settlement_id", "ref", "amount_cents").agg((F.min("source") != F.max("source")).alias("both"))
    return feeds.filter("both").select("settlement_id").distinct()


def unreferenced(members: DataFrame) -> DataFrame:
    """Matched candidates that are not anchored and share no token with an anchored one of their settlement."""
    by = by_pool(members)
    tokens = members.select(*by, "txn_key", "anchor", F.posexplode_outer(refs.tokens(F.col("ref"))).alias("_at", "_token"))
    tied = F.col("_token").isNotNull() & F.max("anchor").over(Window.partitionBy(*by, "_token"))
    own = F.count_if(~F.col("anchor") & (F.coalesce("_at", F.lit(0)) == 0))  # a key that stands twice is two rows
    each = tokens.withColumn("_tied", tied).groupBy(*by, "txn_key").agg(F.max("_tied").alias("_tied"), own.cast("int").alias("_n"))
    return each.filter("NOT _tied").select("settlement_id", F.explode(F.array_repeat("txn_key", F.col("_n"))).alias("txn_key"))


def substitutable(matched: DataFrame, payments: DataFrame) -> DataFrame:
    """Matched payments with a twin of the same amount in another feed of the same group, which is not matched itself."""
    twins = payments.select(F.col("source").alias("twin_source"), F.col("txn_id").alias("twin_id"), F.col("amount_cents").alias("twin_amount"), F.col("ok").alias("twin_ok"))
    pairs = matched.join(twins, (F.col("ok") == F.col("twin_ok")) & (F.col("amount_cents") == F.col("twin_amount")) & (F.col("source") != F.col("twin_source")))
    free = pairs.join(matched.select(F.col("source").alias("twin_source"), F.col("txn_id").alias("twin_id")), ["twin_source", "twin_id"], "left_anti")
    return free.select("source", "txn_id", "twin_source", "twin_id")


def substituted(members: DataFrame, candidates: DataFrame, window: DataFrame) -> DataFrame:
    """Settlements with a matched payment that another feed's copy could replace: of the same amount, in the window, but outside the
    candidates that were solved over. Anchored members and those of the settlement's member feed are exempt.

    members: settlement_id, txn_key. candidates: also source, amount_cents, anchor and ``feed`` (null: none known). window: all of the pool.
    Amounts outside are counted once for each feed before they are joined.
    """
    outside = window.join(candidates, ["settlement_id", "txn_key"], "left_anti").select("settlement_id", "amount_cents", F.col("source").alias("_other")).distinct()
    weak = candidates.filter(~F.col("anchor") & ~F.coalesce(F.col("source") == F.col("feed"), F.lit(False))).select("settlement_id", "txn_key", "source", "amount_cents")
    return members.join(weak, ["settlement_id", "txn_key"]).join(outside, ["settlement_id", "amount_cents"]).filter("source <> _other").select("settlement_id").distinct()


def interchangeable(pool: DataFrame, picked: DataFrame) -> DataFrame:
    """Groups of candidates alike in amount, currency and reference of which only some were picked, and the
    oldest-first proposal. pool and picked: txn_id, amount_cents, currency, ref; pool also ts."""
    sign = ["amount_cents", "currency", "ref"]
    wanted = picked.groupBy(*sign).agg(F.count(F.lit(1)).alias("n_picked"))
    order = Window.partitionBy(*sign).orderBy("ts", "txn_id")
    rows = pool.withColumn("n_pool", F.count(F.lit(1)).over(Window.partitionBy(*sign))).withColumn("place", F.row_number().over(order))
    return rows.join(wanted, sign).filter("n_pool > n_picked AND place <= n_picked").select("txn_id", "n_pool", "n_picked", "place")

"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A document of a source with n rows and target weight w gets a number of copies drawn from a Poisson
distribution with mean w * total / n. The draw inverts the distribution at a uniform number taken from a
hash of the seed and the document's id, so it is the same on every run, on every partitioning and after
a lost executor. A mean above ``SHARE`` is parted into equal shares, each with a draw of its own: their sum has the Poisson
distribution of the whole mean, and no share needs more than a few hundred steps. Copies are exploded, by blocks and then
singly, and dealt out globally by a hash of seed, id and copy.

Only the named sources (and all others together) are counted on the driver: as many numbers as the
caller gave weights, plus one.

Defined cases: a null source, and one without a weight of its own, belongs to ``OTHERS``; a null id hashes
as the empty string; rows with the same id draw the same number; null and empty texts are documents like
any other; groups without rows leave their weight to the rest in proportion; an empty table stays empty. Input columns
called n_copies, copy or shuffle_key are replaced by the result's; all others are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitweave.llm.common import fresh

OTHERS = "*"
#: Largest mean of one draw, and copies to a block of the first explosion.
SHARE, BLOCK = 128, 1 << 16


def poisson_cdf(mean: float) -> list[float]:
    """P(X <= 0), P(X <= 1), ... up to where nothing of a double is left."""
    if mean <= 0:
        return []
    out, total, k = [], 0.0, 0
    spread = mean + 40 + 12 * math.sqrt(mean)
    while k <= spread and total < 1 - 2**-53:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        out.append(total)
        k += 1
    return out


def group_of(source: Column, names: list[str]) -> Column:
    return F.when(source.isin(names), source).otherwise(F.lit(OTHERS)) if names else F.lit(OTHERS)


def uniform(seed: int, ident: Column, share: Column | None = None) -> Column:
    """In [0, 1), from 52 bits of an MD5 sum. ``share``: number of a further draw for the same document."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))
    if share is not None:
        text = F.concat(F.lit(f"{seed}/"), share.cast("string"), F.lit(":"), F.coalesce(ident.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float], source_col: str, total: int | None) -> dict[str, float]:
    """Mean copies per document of each group that has rows."""
    names = sorted(set(weights) - {OTHERS})
    counts = {r["g"]: r["n"] for r in docs.groupBy(group_of(F.col(source_col), names).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    held = sum(weights.get(g, 0.0) for g in counts)
    want = sum(counts.values()) if total is None else total
    return {g: weights.get(g, 0.0) / held * want / n if held else 0.0 for g, n in counts.items()}


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    *,
    total: int | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with n_copies, copy (from 1) and shuffle_key, one row per copy, in globally shuffled order.

    ``weights``: share of the result by source; ``OTHERS`` stands for all sources not named.
    ``total``: expected number of rows, as many as ``docs`` has by default.
    """
    names = sorted(set(weights) - {OTHERS})
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_copies", "copy", "shuffle_key")])
    group, u, block = (fresh(docs, x) for x in ("_group", "_u", "_block"))
    n = F.lit(0).cast("bigint")
    for name, mean in sorted(rates(docs, weights, source_col, total).items()):
        if mean > 0:
            n = F.when(F.col(group) == name, drawn(mean, F.col(u), seed, F.col(id_col))).otherwise(n)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy").cast("string")))
    first = F.col(block) * BLOCK
    return (
        docs.withColumn(group, group_of(F.col(source_col), names))
        .withColumn(u, uniform(seed, F.col(id_col)))
        .withColumn("n_copies", n.cast("int"))
        .filter("n_copies > 0")
        .drop(group, u)
        .withColumn(block, F.explode(F.sequence(F.lit(0), F.floor((F.col("n_copies") - 1) / BLOCK).cast("int"))))
        .withColumn("copy", F.explode(F.sequence(first + 1, F.least(first + BLOCK, F.col("n_copies")))))
        .drop(block)
        .withColumn("shuffle_key", key)
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


def drawn(mean: float, u: Column, seed: int, ident: Column) -> Column:
    """Copies: the distribution's inverse at u, and at a uniform number of its own for each further share of the mean."""
    shares = math.ceil(mean / SHARE)
    steps = F.array(*[F.lit(x) for x in poisson_cdf(mean / shares)])

    def inverse(at: Column) -> Column:
        return F.size(F.filter(steps, lambda c: c <= at)).cast("bigint")

    if shares == 1:
        return inverse(u)
    return F.aggregate(F.sequence(F.lit(2), F.lit(shares)), inverse(u), lambda n, j: n + inverse(uniform(seed, ident, j)))


def mix_sql(table: str, weights: dict[str, float], columns: str, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> str:
    """The same rows in DuckDB's SQL, ``total`` left at its default; ``columns``: those of d that are wanted."""
    names = sorted(set(weights) - {OTHERS})
    listed = ", ".join(f"'{x}'" for x in names)
    w = ", ".join(f"('{g}', {x!r}::DOUBLE)" for g, x in sorted(weights.items()))
    return f"""
WITH d AS (SELECT *, CASE WHEN {source_col} IN ({listed}) THEN {source_col} ELSE '{OTHERS}' END AS g_,
                  ('0x' || substr(md5('{seed}:' || coalesce({id_col}::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u_
           FROM {table}),
     c AS (SELECT g_, count(*) AS n FROM d GROUP BY g_),
     w AS (SELECT * FROM (VALUES {w}) AS t(g_, weight)),
     r AS (SELECT c.g_, w.weight / sum(w.weight) OVER () * sum(c.n) OVER () / c.n AS mean FROM c JOIN w USING (g_)),
     s AS (SELECT g_, ceil(mean / {SHARE})::BIGINT AS shares, mean / ceil(mean / {SHARE}) AS mean FROM r WHERE mean > 0),
     p AS (SELECT g_, shares, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY g_ ORDER BY k) AS cdf
           FROM s, generate_series(0, {3 * SHARE}) AS t(k)),
     n AS (SELECT g_, shares, list(cdf ORDER BY k) AS steps FROM p GROUP BY ALL),
     e AS (SELECT d.*, (len(list_filter(steps, lambda x: x <= u_)) + coalesce(list_sum(list_transform(range(2, shares + 1), lambda j: len(list_filter(steps, lambda x:
                  x <= ('0x' || substr(md5('{seed}/' || j || ':' || coalesce({id_col}::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)))), 0))::INTEGER AS n_copies
           FROM d JOIN n USING (g_))
SELECT {columns}, n_copies, copy::INTEGER AS copy,
       md5('{seed}:' || coalesce({id_col}::VARCHAR, '') || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(generate_series(1, n_copies)) AS copy FROM e WHERE n_copies > 0)"""

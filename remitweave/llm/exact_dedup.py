"""Exact deduplication by a log-structured merge index of text digests, in DataFrame operations only.

* memtable flush: each input partition becomes one run of (digest, identifier, length) entries, sorted by
  digest, written to the shared folder;
* filters: each run has a bit filter of its digests. Where the filters of all runs, laid over one another, have a bit once only,
  its entry is in no other run: it passes without being looked up anywhere, or shuffled;
* compaction: the entries that remain are merged by digest, ``FANOUT`` runs to a run of the next level, until one is left; of equal
  digests the smallest identifier among the longest originals survives, with the count of all;
* hits: a bit filter of fixed size over the identifiers with a partner tells which texts are read again and shuffled;
* byte verification: a digest whose normalised texts are not all the same bytes (min = max) is regrouped by
  the bytes themselves.

Aggregations combine before the shuffle, so a group that holds a third of all rows sends one row per task.

Defined cases: null text counts as empty; a null identifier loses to any other; of rows that tie in
length and identifier one stays (which, if their other columns differ, is not defined); an empty table gives an empty
result; other columns, whatever their names, are ignored, and ``survivors`` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitweave.llm.common import flag_by_bits, fresh, id_bits, materialise

#: The characters that don't count: space and U+0009 to U+000D.
BLANKS = " \t\n\v\f\r"
#: Runs that are merged into one of the next level.
FANOUT = 1024


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _entries(docs: DataFrame, id_col: str, text_col: str, key_bytes: int) -> DataFrame:
    """row: tells equal rows apart; it is read only after it has been written."""
    return (
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
            F.monotonically_increasing_id().alias("row"),
            F.spark_partition_id().alias("run"),
        )
        .withColumn("_norm", normalised(F.col("_text")))
        .withColumn("length", F.char_length("_text"))
        .withColumn("digest", F.unhex(F.sha2("_norm", 256)))
        .withColumn("key", F.substring("digest", 1, key_bytes))
    )


def _winner() -> Column:
    return F.min(
        F.struct((-F.col("length")).alias("neg"), F.col("id").isNull().alias("no_id"), "id", "row")
    ).alias("w")


def _shared_bits(runs: DataFrame, log2_bits: int) -> DataFrame:
    """(word, bits): the places that entries of several runs, or several of one, have in the runs' filters. At most 2**(log2_bits-6) rows.

    Where a run has fewer bits in a word than entries, all its bits there count as shared.
    """
    pos = F.pmod(F.xxhash64("key"), F.lit(1 << log2_bits))
    filters = (
        runs.select("run", F.shiftright(pos, 6).alias("word"), (pos % 64).cast("int").alias("bit"))
        .groupBy("run", "word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count(F.lit(1)).alias("n"))
        .select("word", "bits", F.when(F.col("n") > F.bit_count("bits"), F.col("bits")).otherwise(F.lit(0)).alias("twice"))
    )
    laid = F.aggregate(
        F.collect_list(F.struct("bits", "twice")),
        F.struct(F.lit(0).cast("bigint").alias("any"), F.lit(0).cast("bigint").alias("shared")),
        lambda a, x: F.struct(
            a["any"].bitwiseOR(x["bits"]).alias("any"), a["shared"].bitwiseOR(x["twice"]).bitwiseOR(a["any"].bitwiseAND(x["bits"])).alias("shared")
        ),
    )
    return filters.groupBy("word").agg(laid["shared"].alias("bits")).filter("bits <> 0")


def _compacted(entries: DataFrame) -> DataFrame:
    """key, w (the surviving entry) and n, by merging runs level by level."""
    level = entries.select("run", "key", F.struct((-F.col("length")).alias("neg"), F.col("id").isNull().alias("no_id"), "id", "row").alias("w"), F.lit(1).cast("bigint").alias("n"))
    last = entries.agg(F.max("run")).first()[0] or 0
    while last >= FANOUT:
        last //= FANOUT
        merged = level.groupBy(F.floor(F.col("run") / FANOUT).cast("int").alias("run"), "key").agg(F.min("w").alias("w"), F.sum("n").alias("n"))
        level = materialise(merged.sortWithinPartitions("key"))
    return materialise(level.groupBy("key").agg(F.min("w").alias("w"), F.sum("n").alias("n")))


def _assign(entries: DataFrame, level: DataFrame, on: list[str]) -> DataFrame:
    return entries.join(level, on).select(
        F.col("id"),
        F.col("w.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("w.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("length"),
    )


def assign(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = 32, log2_bits: int = 24
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, length (code points).

    ``key_bytes``: digest bytes of the index key; fewer make collisions, which verification resolves.
    ``log2_bits``: size of the filters; a full filter costs a larger shuffle, never a result.
    """
    runs = materialise(
        _entries(docs, id_col, text_col, key_bytes).select("run", "key", "digest", "id", "length", "row").sortWithinPartitions("key")
    )
    shared = materialise(_shared_bits(runs, log2_bits))
    flagged = flag_by_bits(runs, F.col("key"), shared, log2_bits, "maybe")
    alone = flagged.filter("NOT maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "length"
    )
    runs = flagged.filter("maybe").drop("maybe")
    level = _compacted(runs)

    hits = runs.join(level.filter("n > 1").select("key"), "key", "left_semi")
    bits = materialise(id_bits(hits, F.col("id"), log2_bits))
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    maybe = flag_by_bits(plain, F.col("id"), bits, log2_bits, "_maybe").filter("_maybe")
    seen = _entries(maybe, "id", "text", key_bytes)
    clashes = materialise(
        seen.groupBy("key").agg(F.min("_norm").alias("a"), F.max("_norm").alias("b")).filter("a != b").select("key")
    )
    if clashes.isEmpty():
        return alone.unionByName(_assign(runs, level, ["key"]))

    rows = materialise(
        seen.join(clashes, "key", "left_semi").select("key", "_norm", "digest", "id", "length", "row")
    )
    exact = rows.groupBy("key", "_norm").agg(_winner(), F.count(F.lit(1)).alias("n"))
    settled = alone.unionByName(_assign(runs.join(clashes, "key", "left_anti"), level, ["key"]))
    return settled.unionByName(_assign(rows, exact, ["key", "_norm"]))


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", log2_bits: int = 24) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns. Documents outside the hit filter pass without a shuffle."""
    found = materialise(assign(docs, id_col=id_col, text_col=text_col, log2_bits=log2_bits))
    bits = materialise(id_bits(found.filter("group_size > 1"), F.col("id"), log2_bits))
    name = fresh(docs, "_maybe")
    flagged = flag_by_bits(docs, F.col(id_col), bits, log2_bits, name)
    kept = found.filter("kept").select("id", "length", "text_sha256")
    sha, length = fresh(docs, "_sha"), fresh(docs, "_length")
    maybe = (
        flagged.filter(name)
        .drop(name)
        .withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
        .withColumn(length, F.char_length(F.coalesce(F.col(text_col), F.lit(""))))
    )
    stay = (
        maybe.join(
            kept,
            (maybe[sha] == kept["text_sha256"])
            & (maybe[length] == kept["length"])
            & maybe[id_col].eqNullSafe(kept["id"]),
            "left_semi",
        )
        .dropDuplicates([sha])
        .drop(sha, length)
    )
    return flagged.filter(~F.col(name)).drop(name).unionByName(stay)

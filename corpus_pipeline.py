"""A training corpus from raw documents: quality, exact copies, near copies, mixing, packing.

Each stage works on what its predecessor kept, read again from Parquet. All but the last return the columns of
``documents``; the mixed corpus holds a document once for each of its copies.

Defined cases, of every stage: null and empty texts are scored, and if they stay are one group of exact copies, pieces of their end id alone; a text of any length is read
whole; a null id loses to any other of its group; rows that tie in length and id leave one of them; a null source is a source without a weight of its own; repeated
rows are copies of one another; an empty table passes through as one; columns beside those of ``documents`` are kept up to the last stage, but that
ones called n_copies, copy or shuffle_key hold what the mixing stage makes of them (``mixing``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from remitweave.llm import exact_dedup, mixing, packing, quality, simhash
from remitweave.llm.common import documents, materialise
from remitweave.llm.queries import MIX_WEIGHTS, vocabulary

#: Near copies: five-word shingles, 256-bit fingerprints. Two documents whose shingle sets have a Jaccard similarity of
#: 0.8 have a cosine of 0.89, so their fingerprints differ in 39 bits on average (standard deviation 6). Pairs within 60 bits are
#: candidates; a link needs that similarity of the sets themselves, and so sets of sizes in that ratio.
NEAR = {"words_each": 5, "parts": 4, "radius": 60, "min_ratio": 0.8, "min_jaccard": 0.8}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below 0.3."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, white space aside."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8."""
    return simhash.survivors(docs, **NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources have their target shares, in shuffled order."""
    return mixing.mix(docs, MIX_WEIGHTS).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids, one row per piece."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL for trained scores, fingerprints and tokens: tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

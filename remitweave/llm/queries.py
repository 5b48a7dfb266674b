"""The registered queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitweave.llm import ann, binary_output, exact_dedup, language_id, mixing, packing, pii, quality, secret_scan, simhash, token_counts, vector_codes, whitening
from remitweave.llm.common import documents

#: Target shares of the mixed corpus. ``mixing.OTHERS``: all sources not named.
MIX_WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.05, mixing.OTHERS: 0.55}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=remainder(5) != 0)
    found = quality.score(docs, model, ["doc_id"])
    return found.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), MIX_WEIGHTS)


OP2_SQL = mixing.mix_sql("documents", MIX_WEIGHTS, "doc_id, text, lang, source, n_chars")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, F.col("vec_id") % 20 == 0, k=20).withColumnRenamed("id", "vec_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), with_ids=False)
    return found.withColumnRenamed("id", "doc_id")


def op5_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binary_output.round_trip(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1, with_ids=False)
    return found.withColumnRenamed("id", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(docs, learn=remainder(4) != 2)
    found = language_id.identify(docs, model, ["doc_id"])
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS place,
                  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), words_each=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), F.col("fp").alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return pii.detect(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        *[pii.count(spans, kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.joined(spans, pii.BASE), 256).alias("base_sha256"),
        pii.joined(spans).alias("spans"),
        F.size(spans).cast("bigint").alias("n_spans"),
        *[pii.count(spans, kind).alias(f"n_{kind}") for kind in pii.KINDS if kind not in pii.BASE],
        F.array_join(F.transform(spans, lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return secret_scan.scan(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        *[secret_scan.count(spans, kind).alias(f"n_{kind}") for kind in secret_scan.BASE],
        F.sha2(secret_scan.joined(spans, secret_scan.BASE), 256).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"),
        secret_scan.count(spans, "literal").alias("n_literal"),
        F.array_join(F.transform(F.filter(spans, lambda s: s["kind"] == "literal"), lambda s: F.concat_ws(":", s["target"], F.round(s["score"], 2))), ",").alias("targets"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_ann": op3_ann,
    "op4_packing": op4_packing,
    "op5_binary_output": op5_binary_output,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
    "op11_whitening": op11_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES: dict[str, str] = {"op2_mixing": OP2_SQL, "op7_exact_dedup": OP7_SQL}

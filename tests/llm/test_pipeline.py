import hashlib
import math
import random
import re

from pyspark.sql import functions as F
from test_near_jaccard import brute_survivors
from tokenizers import Tokenizer

import corpus_pipeline as cp
from remitweave.llm import quality
from remitweave.llm.queries import MIX_WEIGHTS, vocabulary


def corpus(spark, path):
    rng = random.Random(4)
    rows, labels = [], []

    def text(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)) + "."

    for k in range(60):
        rows.append((k, text(150)))
        labels.append((k, 1))
    for k in range(60, 90):
        rows.append((k, " ".join(w + "$$$" for w in text(80).split())))
        labels.append((k, 0))
    rows.append((200, rows[0][1] + "  "))
    rows.append((201, rows[1][1].replace(" ", "  ", 1)))
    near = rows[2][1].split()
    near[70] = "changed"
    rows.append((202, " ".join(near)))
    docs = [(i, t, "en", f"src{i % 5}", len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").distinct().collect()})
        assert k == len(cp.STAGES) - 1 or docs.columns == columns
    clean = set(range(60)) | {200, 201, 202}
    assert kept[0] == clean
    assert kept[1] == clean - {0, 1}  # the longer original stays
    assert kept[2] == clean - {0, 1, 202}
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    assert docs.filter("length > 1024").count() == 0
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, cp.run(spark, str(tmp_path)).select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))


def plain_pipeline(spark, docs, labels):
    """Every decision of the four filtering stages over plain lists; the classifier's scores are its own."""
    model = quality.train(docs, labels)
    scored = quality.score(docs, model, ["doc_id", "text", "source"]).collect()
    rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in scored if r["score"] >= 0.3]
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1]), []).append(r)
    big = 1 << 60
    rows = sorted((min(g, key=lambda r: (-len(r[1]), big if r[0] is None else r[0])) for g in groups.values()), key=lambda r: big if r[0] is None else r[0])
    stay = brute_survivors([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if r[0] in stay]
    names = set(MIX_WEIGHTS) - {"*"}
    of = lambda r: r[2] if r[2] in names else "*"
    counts = {g: sum(of(r) == g for r in rows) for g in {of(r) for r in rows}}
    held, out = sum(MIX_WEIGHTS[g] for g in counts), []
    for r in rows:
        mean = MIX_WEIGHTS[of(r)] / held * len(rows) / counts[of(r)]
        u = int(hashlib.md5(f"17:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        n, total = 0, math.exp(-mean)
        while total <= u:
            n += 1
            total += math.exp(n * math.log(mean) - mean - math.lgamma(n + 1))
        out += [r] * n
    return [r[:2] for r in out]


def test_run_matches_a_plain_version(spark, odd_docs, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows: the packed pieces hold just the documents that a plain version keeps."""
    corpus(spark, tmp_path)
    base = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = odd_docs.select((F.col("doc_id") + 1000).alias("doc_id"), *base.columns[1:]).filter("doc_id IS NOT NULL")
    docs = base.unionByName(odd)
    docs.write.parquet(f"{tmp_path}/all/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/all/labels.parquet")
    want = {}
    encode = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for ident, text in plain_pipeline(spark, docs, labels):
        want[ident] = want.get(ident, 0) + len(encode.encode(text, add_special_tokens=False).ids) + 1
    found = cp.run(spark, f"{tmp_path}/all").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in found} == want


def test_run_on_empty_tables(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0

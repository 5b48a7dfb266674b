"""Quality, language and neighbours: held-out accuracy, brute force and the defined cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from remitweave.llm import ann, language_id, quality

DATA = "/root/testdata/sf0.01"


def test_rules_agree_with_their_column(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.random((600, len(quality.STATS))), 6)
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.6)).astype(float)
    model = quality.fit(x, y)
    p = 1 / (1 + np.exp(-model.raw(x)))
    assert ((p >= 0.5) == y).mean() > 0.95 and 0 < len(model.rules) < 200
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATS))
    scored = df.select(model.column().alias("s")).toPandas()["s"].to_numpy()
    assert np.allclose(np.sort(scored), np.sort(p))


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.train(docs, labels, learn=~held)
    rows = quality.score(docs, model, ["doc_id"]).join(labels, "doc_id").filter(held).toPandas()
    assert ((rows.score >= 0.3) == (rows.quality == 1)).mean() > 0.95


def test_quality_defined_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (5, None), (None, 1), (9, 7), (100, 1), (101, 1)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    rows = quality.score(odd_docs, model, ["doc_id"]).toPandas()
    assert len(rows) == odd_docs.count() and rows.score.between(0, 1).all()
    kept = quality.accepted(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    none = quality.train(odd_docs, labels.filter("false"))
    assert set(quality.score(odd_docs, none, ["doc_id"]).toPandas().score) == {0.5}
    assert quality.score(no_docs, quality.train(no_docs, labels), ["doc_id"]).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.train(docs, learn=~held)
    rows = language_id.identify(docs, model, ["doc_id", "lang"]).filter(held).toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.95
    assert (model.weights == 0).mean() > 0.5


def naive_prediction(model, text):
    """Dictionaries and whole numbers only: n-grams, their places, TF-IDF, probabilities."""
    codes = [ord(c) if c.isalpha() else 32 for c in (text or "").lower()]
    if all(c == 32 for c in codes):
        return "und", 0.0
    codes = [c for k, c in enumerate(codes) if c != 32 or k == 0 or codes[k - 1] != 32]
    m, counts = 1 << 64, {}
    padded = [32, *codes, 32]
    c = [(x + 7) * 0xC2B2AE3D27D4EB4F % m for x in padded]
    two = [(a ^ b >> 7) * 0x165667B19E3779F9 % m for a, b in zip(c, c[1:])]
    three = [(a ^ b >> 13) * 0x27D4EB2F165667C5 % m for a, b in zip(two, c[2:])]
    for h in [*((x + 1) * 0x9E3779B97F4A7C15 % m for x in codes), *two, *three]:
        counts[h >> 48] = counts.get(h >> 48, 0) + 1
    x = {p: math.log(1 + n) * float(model.idf[p]) for p, n in counts.items()}
    size = math.sqrt(sum(v * v for v in x.values()))
    z = [sum(v / size * float(model.weights[p, k]) for p, v in x.items()) / model.temperature for k in range(len(model.languages))]
    e = [math.exp(v - max(z)) for v in z]
    k = e.index(max(e))
    return model.languages[k], e[k] / sum(e)


def test_language_matches_a_naive_version(spark, odd_docs):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    some = docs.filter("doc_id % 10 = 0").unionByName(odd_docs.select("doc_id", "text", "lang"))
    for r in language_id.identify(some, model, ["text"]).collect():
        lang, score = naive_prediction(model, r["text"])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9
    texts = {r["text"] for r in docs.collect() if r["text"]}
    n = sum(any(c.isalpha() for c in r["text"] or "") for r in docs.select("text").collect())
    assert texts and model.idf.max() <= math.log(1 + n) + 1 + 1e-12


def test_every_language_is_learned(spark):
    """300 languages, beyond which places are fewer; most have a single document."""
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{'qxzj'[k % 4]}{chr(97 + k * 7 % 26)}" for k in range(300)]
    rows = [(k, f"{words[k % 300]} " * 30, f"l{k % 300:03}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model.languages) == 300 and model.weights.shape == (1 << 15, 300)
    found = language_id.identify(docs, model, ["doc_id", "lang"]).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) > 0.95 * len(found)


def test_long_texts_are_learned_within_the_bound(spark, monkeypatch):
    """A language whose documents are all long is learned from its whole first one; what the driver gets is bounded."""
    monkeypatch.setattr(language_id, "ENTRIES", 600)
    rows = [(k, " ".join(f"xyz{'abcdefghij'[j * 7 % 10]}{'klmnop'[j % 6]}" for j in range(60_000)), "long") for k in range(3)]
    rows += [(10 + k, f"wert huio {k}", "short") for k in range(200)]
    seen = []
    fit = language_id.ftrl
    monkeypatch.setattr(language_id, "ftrl", lambda model, examples, classes: (seen.extend(zip(examples, classes, strict=True)), fit(model, examples, classes)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == ("long", "short")
    whole = [e for e, c in seen if c == 0]
    assert max(int(n.sum()) for _, n in whole) > 3 * 60_000 * 5  # one-, two- and three-letter pieces of the whole text
    assert sum(len(at) for (at, _), c in seen if c == 1) <= 300
    found = language_id.identify(docs, model, ["doc_id", "lang"]).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found)


def test_language_defined_cases(odd_docs, no_docs):
    model = language_id.train(odd_docs)
    rows = language_id.identify(odd_docs, model, ["doc_id", "text"]).toPandas()
    letterless = rows[[not any(c.isalpha() for c in t or "") for t in rows.text]]
    assert len(rows) == odd_docs.count() and (letterless.lang_pred == "und").all() and (letterless.score == 0).all()
    assert rows.score.between(0, 1).all() and set(rows.lang_pred) <= {"und", "en", "de", "fr"}
    nothing = language_id.train(no_docs)
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert language_id.identify(no_docs, model, ["doc_id"]).count() == 0


def brute(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q in ok:
        if q % 20 == 0:
            near = sorted((-float(ok[q] @ ok[i]), i) for i in ok if i != q)[:k]
            out += [(q, r, i, round(-s, 9)) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def test_neighbours_exact_when_all_lists_are_probed(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 4)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(12)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 400)]  # a group of equal vectors, queries among them
    rows += [(400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] * 12), (404, [None] * 12), (405, [1.0]), (None, rows[3][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id string")
    found = ann.search(df, F.col("vec_id") % 20 == 0, k=20, probe_share=1.0).collect()
    clean = [(i, v) for i, v in rows if v is None or len(v) == 12]
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in found) == brute(clean, 20)


def test_neighbours_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found = ann.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in found] == [(1, 0.5), (2, 0.0)]
    assert ann.search(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df, F.col("vec_id") < 0).count() == 0


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.search(df, F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.collect_list("id").alias("ids")).toPandas()
    ok = df.filter(ann.finite(F.col("embedding").cast("array<double>"))).toPandas().sort_values("vec_id")
    ids, x = ok.vec_id.to_numpy(), np.stack(ok.embedding.to_numpy()).astype(float)
    shares = []
    for q, got in zip(found.query_id, found.ids, strict=True):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        shares.append(len(set(got) & set(ids[np.argsort(-s, kind="stable")[:20]].tolist())) / 20)
    assert len(shares) == sum(ids % 20 == 0) and np.mean(shares) >= 0.9


def test_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(df, F.col("vec_id") % 100 == 0).toPandas().groupby("query_id").id.apply(set)
    s = x[::100] @ x.T
    s[np.arange(60), np.arange(0, 6000, 100)] = -np.inf
    assert np.mean([len(found[100 * i] & set(np.argsort(-r)[:20].tolist())) / 20 for i, r in enumerate(s)]) >= 0.9

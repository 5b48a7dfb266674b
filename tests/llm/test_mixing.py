import duckdb

from remitweave.llm import mixing

WEIGHTS = {"src0": 0.6, "src1": 0.1, mixing.OTHERS: 0.3}


def test_cdf_is_poisson():
    cdf = mixing.poisson_cdf(3.0)
    assert abs(cdf[0] - 2.718281828459045**-3) < 1e-12 and abs(cdf[-1] - 1) < 1e-12
    assert mixing.poisson_cdf(0) == []
    assert abs(mixing.poisson_cdf(900.0)[900] - 0.5) < 0.02


def test_matches_sql(odd_docs):
    documents = odd_docs.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(mixing.mix_sql("documents", WEIGHTS, "doc_id, source")).fetchall()
    found = mixing.mix(odd_docs, WEIGHTS).select("doc_id", "source", "n_copies", "copy", "shuffle_key").collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found)


def test_shares_and_repeatability(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'src0' WHEN id % 3 = 1 THEN 'src1' END AS source")
    counts = {r["source"]: r["count"] for r in mixing.mix(docs, WEIGHTS).groupBy("source").count().collect()}
    total = sum(counts.values())
    assert abs(counts["src0"] / total - 0.6) < 0.02 and abs(counts[None] / total - 0.3) < 0.02
    again = mixing.mix(docs.repartition(7), WEIGHTS)
    assert again.exceptAll(mixing.mix(docs, WEIGHTS)).count() == 0


def test_large_means_and_clashing_names(spark, monkeypatch):
    """One document in a source of half the weight, and columns with the names that are used inside."""
    docs = spark.range(9_000).selectExpr("id AS doc_id", "if(id = 0, 'src0', 'src1') AS source", "1 AS _group", "2 AS _u", "3 AS _block", "4 AS copy", "5 AS n_copies")
    weights = {"src0": 0.5, "src1": 0.5}
    monkeypatch.setattr(mixing, "BLOCK", 1000)
    found = mixing.mix(docs, weights)
    rows = found.groupBy("doc_id").agg({"copy": "max", "n_copies": "max", "*": "count"}).toPandas().set_index("doc_id")
    n = int(rows["count(1)"][0])
    assert abs(n - 4500) < 6 * 4500**0.5 and rows["max(copy)"][0] == rows["max(n_copies)"][0] == n
    assert found.select("doc_id", "copy").distinct().count() == found.count()
    assert [tuple(r) for r in found.select("_group", "_u", "_block").distinct().collect()] == [(1, 2, 3)]
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "source").toPandas())
    want = con.execute(mixing.mix_sql("documents", weights, "doc_id, source")).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in found.select("doc_id", "source", "n_copies", "copy", "shuffle_key").collect())


def test_shares_have_the_whole_means_distribution(spark):
    docs = spark.range(4_000).selectExpr("id AS doc_id", "'src0' AS source")
    counts = mixing.mix(docs, {"src0": 1.0}, total=4_000 * 300).groupBy("doc_id").count().toPandas()["count"]
    assert len(counts) == 4_000 and abs(counts.mean() - 300) < 1.2 and abs(counts.var() - 300) < 30


def test_empty(no_docs):
    assert mixing.mix(no_docs, WEIGHTS).count() == 0

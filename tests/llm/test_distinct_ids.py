from remitweave.llm import language_id


def test_repeated_and_null_ids_leave_the_sample_whole(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 10)
    rows = [(k % 40, f"the cat sat on mat {k % 40}", "en") for k in range(8000)]
    rows += [(1000 + k, f"der hund und die katze {k}", "de") for k in range(5)] + [(None, "der hund", "de")] * 20_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "ftrl", lambda model, texts, classes: seen.extend(classes))
    monkeypatch.setattr(language_id, "calibrated", lambda model, texts, classes: seen.extend(classes) or 1.0)
    monkeypatch.setattr(language_id, "SNIPPETS", ())
    model = language_id.train(docs)
    assert model.languages == ("de", "en") and (seen.count(0), seen.count(1)) == (5, 10)

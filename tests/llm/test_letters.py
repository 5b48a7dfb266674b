from remitweave.llm import language_id


def test_symbols_above_ffff_are_not_letters(spark):
    assert all(len(language_id.places(t)[0]) == 0 for t in ("\U0001f600\U0001f680 12", "\U0001f600", "\U0001d7d8\U0001f4a9!", "\U0010ffff"))
    assert [x.tolist() for x in language_id.places("ab\U0001f600cd")] == [x.tolist() for x in language_id.places("ab cd")]
    assert len(language_id.places("\U00010400\U0001d400")[0]) > 0  # Deseret, mathematical letters
    docs = spark.createDataFrame([(k, f"the cat sat on mat {k}", "en") for k in range(20)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.predict("\U0001f600 \U0001f680 12") == ("und", 0.0) and model.predict("the cat")[0] == "en"

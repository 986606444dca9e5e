from textloom.llm import langid


def test_more_languages_than_bits_of_a_word_are_all_learnt(spark):
    letters = [chr(0x4E00 + 40 * k) + chr(0x4E01 + 40 * k) + chr(0x4E02 + 40 * k) for k in range(130)]
    rows = [(1000 * k + i, f"{w}{w} {w} {w[::-1]}{w}", f"l{k:03}") for k, w in enumerate(letters) for i in range(5 if k < 70 else 4)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, scores = langid.predict_texts([f"{w} {w}{w}" for w in letters], model)
    assert names == [f"l{k:03}" for k in range(130)] and (scores > 0.5).all()

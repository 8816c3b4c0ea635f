from promoscope.llm import langid, queries


def test_held_out_accuracy(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "lang")
    got = queries.op8_langid(spark, sf_small).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(1, "the cat and the dog sat here", "en"), (2, "der Hund und die Katze schliefen", "de"), (3, None, "en"), (4, "12 !? 34", "de"),
            (5, "", None), (6, "the the and the", None), (7, "und die der und", None), (6, "the the and the", None), (8, "the " * 90_000, None)] * 6
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").coalesce(2)
    model = langid.fit(df)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert {k: got[k].lang_pred for k in (3, 4, 5)} == dict.fromkeys((3, 4, 5), "und") and got[4].score == 0 and not got[3].accepted
    assert got[6].lang_pred == "en" and got[7].lang_pred == "de" and got[8].lang_pred == "en"
    assert langid.predict(df.limit(0), model).collect() == []
    none = langid.fit(df.filter("lang IS NULL"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_pieces_of_a_long_text_add_up(monkeypatch):
    model = langid.train([("the cat sat on the mat", "en"), ("der Hund lag auf dem Sofa", "de")] * 5)
    text = "the cat sat on dem Sofa " * 400
    whole = model.logits([text])[0]
    monkeypatch.setattr(langid, "_PIECE", 1000)
    assert abs(model.logits([text])[0] - whole).max() < 1e-6

import numpy as np

from ebbtide.llm.language import bucket_counts, grams, identify_languages


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify_languages(docs).join(docs, "doc_id").where("held_out").selectExpr("avg(int(lang = lang_pred))", "count(*)").first()
    assert found[0] > 0.99 and found[1] > 250


def test_predictions_read_the_text_alone(spark):
    docs = spark.createDataFrame(
        [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 12)],
        "doc_id long, text string, lang string",
    )
    found = {r.doc_id: r.lang_pred for r in identify_languages(docs).collect()}
    assert all(found[k] == ("en", "de")[k % 2] for k in found)


def test_odd_rows(spark):
    rows = [(k, "abc abd", "x") for k in range(9)] + [(20, None, "x"), (21, "", "x"), (22, "12 !? 3", "x"), (23, "zzz", None), (None, "abc", "x")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    found = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs).collect()}
    assert found[20] == found[21] == found[22] == ("und", 0.0)
    assert found[23] == ("x", 1.0) and found[None][0] == "x"
    assert identify_languages(docs.where("false")).count() == 0
    unlabelled = docs.where("doc_id = 23")
    assert [(r.lang_pred, r.score) for r in identify_languages(unlabelled).collect()] == [("und", 0.0)]


def test_counts_and_row_ends(spark):
    data, rows = np.frombuffer("abcdé".encode(), np.uint8), np.array([0, 2, 6])
    slots, at, letters = grams(data, rows, 64)
    assert letters.tolist() == [2, 3] and at.tolist() == [0, 2, 5]
    assert [(s == 64).tolist() for s in slots] == [[False] * 5, [False, True, False, False, True], [True, True, False, True, True]]
    counts = bucket_counts(spark.createDataFrame([("ab", "x"), ("ab ", "x")], "text string, label string"), 64)
    assert counts.where("bucket < 64").agg({"n": "sum"}).first()[0] == 2 + 1 + 3 + 2 + 1

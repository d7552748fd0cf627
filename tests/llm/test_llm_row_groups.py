"""One row per group of near-duplicates, whatever the ids are."""

from barspark.llm import golay


def test_null_and_repeated_ids_with_different_texts(spark):
    near, far = "one and the same text of some length about nothing in particular", "a wholly other text about ships harbours and the wide sea"
    rows = [(1, near, "a"), (None, near, "b"), (None, far, "c"), (None, "third text without an id that nobody has copied", "d"), (None, "fourth text of its own kind and words", "e"),
            (7, "fifth text under an id that is used twice", "f"), (7, "sixth and different text under the very same id", "g"), (7, near, "h"), (9, far, "i"), (9, far, "i")]
    got = golay.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string"))
    assert got.columns == ["doc_id", "text", "odd.name"]
    assert sorted(r[2] for r in got.collect()) == ["a", "d", "e", "f", "g", "i"]

"""Masses of equal rows, ids with several texts, texts longer than a stretch, and other lengths of n-grams."""

import math
from collections import Counter, defaultdict

import numpy as np

from pyspark.sql import functions as F

from barspark.llm import langid, packing, toxicity


def test_equal_rows_are_packed_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 100)
    parts = spark.range(9_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                                      F.when(F.col("id") < 8_000, 1).otherwise(F.col("id") % 2048 + 1).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    got = packing.pack(parts.repartition(4)).select("sequence_id", "offset", "length").toPandas()
    assert len(got) == 9_000 and not got.duplicated(["sequence_id", "offset"]).any()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= packing.CAPACITY
    assert got["sequence_id"].nunique() == math.ceil(got["length"].sum() / packing.CAPACITY)


def test_lexicon_against_counting(spark):
    """Every word and word beginning with its log-odds, by plain counting over one text per id."""
    texts = [(i, f"you {'nasty zorblax' if i % 4 == 0 else 'kind friendly'} word{i % 7} text {i}") for i in range(80)]
    texts += [(4, "another text of four"), (4, "a third one"), (None, "nasty zorblax")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"y": F.lit("x"), "h": F.lit(1)}).repartition(5)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(4, None), (9, 0)], "doc_id long, toxic int")
    chosen = toxicity.training_rows(docs, labels, None)
    rows = {r.doc_id: (r.h, r.y) for r in chosen.collect()}
    assert set(rows) == set(range(80)) and rows == {r.doc_id: (r.h, r.y) for r in toxicity.training_rows(docs.repartition(2), labels, None).collect()}
    hashes = {r.text: r.h for r in spark.createDataFrame(texts, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    assert rows[4][0] == min(hashes[t] for i, t in texts if i == 4)
    bad, good = Counter(), Counter()
    for i, t in texts:
        if i is not None and hashes[t] == rows[i][0]:
            (bad if rows[i][1] else good).update(toxicity.units(set(toxicity.WORD.findall(t.lower()))))
    n_bad, n_good, want = 20, 60, {}
    for w, b in bad.items():
        g, n = good[w], bad[w] + good[w]
        ratio = b * math.log(b / n / 0.25) + (g * math.log(g / n / 0.75) if g else 0)
        odds = math.log((b + 0.5) / (n_bad - b + 0.5)) - math.log((g + 0.5) / (n_good - g + 0.5))
        if b >= toxicity.LEAST_TEXTS and ratio >= toxicity.LEAST_RATIO and odds > 1:
            want[w] = odds
    got = toxicity.learn_lexicon(docs, chosen)
    assert "nasty" in want and set(got) == set(want) | set(toxicity.BASE_WORDS)
    assert all(abs(got[w] - v) < 1e-9 for w, v in want.items())


def test_long_texts_teach_what_short_ones_do(monkeypatch):
    letters = langid.Letters(64)
    text = "the quick brown fox jumps " * 400
    whole = langid.bundle_sum([text, "abc"], letters)
    monkeypatch.setattr(langid, "GROUP_CHARS", 100)
    assert (langid.bundle_sum([text, "abc"], letters) == whole).all()
    assert np.allclose(langid.bundles([text, "abc"], letters).sum(axis=0), whole)


def test_prediction_uses_the_fitted_length_of_n_grams(spark):
    words = {"en": "the and ing with that", "de": "der und die nicht ein", "xx": "qaq zuz wow pop"}
    rows = [(i, f"{words[k]} " * (1 + i % 3), k) for i, k in enumerate(sorted(words) * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.fit(docs, gram=4, dimensions=256)
    assert profiles.gram == 4
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, profiles, {"doc_id": "doc_id"}).collect()}
    sums = defaultdict(lambda: np.zeros(256))
    vectors = langid.bundles([t for _, t, _ in rows], langid.Letters(256, 4))
    for (_, _, k), v in zip(rows, vectors):
        sums[k] += v
    for (i, _, k), v in zip(rows, vectors):  # the largest cosine, by hand
        cosines = {n: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for n, p in sums.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert got[i][0] == best == k and abs(got[i][1] - cosines[best]) < 1e-9

"""Language profiles and toxicity: definitions, odd rows, held-out accuracy."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from barspark.llm import langid, toxicity
from barspark.llm.common import train_part

SF = "/root/testdata/sf0.01"


def test_bundle_is_the_sum_of_bound_ngrams():
    letters = langid.Letters(64, 3)
    text = "Ab, cä b"
    codes = letters.codes(text).tolist()
    assert codes == [0, ord("a"), ord("b"), 0, ord("c"), ord("ä"), 0, ord("b"), 0]
    v = {c: letters.rows[letters.vector(c)].astype(int) for c in set(codes)}
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(codes, codes[1:], codes[2:]))
    assert (langid.bundles([text], letters)[0] == want).all()
    assert (langid.bundle_sum([text, text, ""], letters) == 2 * want).all()


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = "".join(random.Random(1).choice("abc d") for _ in range(3000))
    letters = langid.Letters(32, 3)
    whole = langid.bundles([text], letters)
    monkeypatch.setattr(langid, "GROUP_CHARS", 100)
    monkeypatch.setattr(langid, "GRAMS", 7)
    assert np.allclose(langid.bundles(["x y", text, ""], letters)[1], whole[0])


def test_language_rows(spark):
    docs = [(i, t, lang, "clash", 1.0) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("", None), ("123 !?", "de"), ("the dog", None), ("the dog", None)] * 2)]
    df = spark.createDataFrame([*docs, (None, "und der", None, "x", 2.0)], "doc_id long, text string, lang string, lang_pred string, score double")
    p = langid.fit(df)
    assert p.languages == ("de", "en")
    got = langid.predict(df, p, {"doc_id": "doc_id"}).collect()
    assert len(got) == 15 and all(0 <= r.score <= 1 for r in got)
    want = {0: "en", 1: "de", 2: "und", 3: "und", 4: "und", 5: "en", 6: "en"}
    assert all(r.lang_pred == want[r.doc_id % 7] for r in got if r.doc_id is not None)
    none = langid.predict(df, langid.fit(df.limit(0)), {"doc_id": "doc_id"}).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.predict(df.limit(0), p, {"doc_id": "doc_id"}).count() == 0


def test_spread_does_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = langid.fit(df), langid.fit(df.repartition(7))
    assert a.languages == b.languages and (a.vectors == b.vectors).all()


def test_held_out_language_accuracy(spark):
    got = entry.queries()["op6_language_profiles"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    assert got.count() == 1000
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert r > 0.97


def test_toxicity_features():
    w = toxicity.Weights({"idiot": 3.0, "gemei-": 2.0})
    f = dict(zip(toxicity.NAMES, toxicity.features("YOU id1ot! so you idiot: i d i o t, gemeinheit", w)))
    assert f["density"] > 0 and f["weight_max"] == 3.0 and f["second_person_near"] == 0.5 and f["beginning_density"] > 0
    assert f["obfuscated_hits"] == pytest.approx(np.log1p(2)) and f["exclamations"] > 0
    assert toxicity.features("", w) == [0.0] * len(toxicity.NAMES)
    assert all(np.isfinite(toxicity.features("a " * 50_000, w)))


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(1, None), (2, 0)]])
def test_toxicity_without_both_classes(spark, labelled):
    df = spark.createDataFrame([(1, "you idiot", "c", 0.1), (2, None, "c", 0.2), (2, "", "c", 0.3), (None, "x", "c", 0.4)], "doc_id long, text string, y string, score double")
    labels = spark.createDataFrame([(*r, 1) for r in labelled], "doc_id long, toxic int, score int")
    got = toxicity.score(df, toxicity.fit(df, labels), {"doc_id": "doc_id", "score0": "score"}).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], df.schema)
    assert toxicity.score(none, toxicity.fit(none, labels), {"doc_id": "doc_id"}).count() == 0


def test_labels_count_once_per_text_and_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"text {i % 10}") for i in range(50)] + [(0, "text 0")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(0, 1)], "doc_id long, toxic int")
    assert toxicity.training_rows(df, labels, None).count() == 10
    assert toxicity.training_rows(df, labels, None, rows=4).count() == 4
    assert {r.y for r in toxicity.training_rows(df, labels, None).where("doc_id = 0").collect()} == {1.0}


def test_held_out_toxicity(spark):
    got = entry.queries()["op7_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    p, n = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    auc = (p[:, None] > n[None, :]).mean() + 0.5 * (p[:, None] == n[None, :]).mean()
    assert auc > 0.85
    assert ((got.predicted == 1) == (got.score >= 0.7)).all()
    assert got[got.toxic == 0].predicted.mean() < 0.02


def test_train_part(spark):
    df = spark.createDataFrame([(i,) for i in range(300)] + [(None,)], "doc_id long")
    import zlib

    got = {r.doc_id: r.t for r in df.select("doc_id", train_part(F.col("doc_id")).alias("t")).collect()}
    assert got.pop(None) is False and all(t == (zlib.crc32(str(i).encode()) % 3 != 1) for i, t in got.items())

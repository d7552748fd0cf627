"""Edit matching, model scoring and the pipeline."""

import collections
import math
import os
import random
import shutil

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from barspark.llm import decontam, lmscore


# ---------------------------------------------------------------- edit matching


def distances(pattern, text):
    """Smallest distance to any part of ``text``, and its first end; the textbook table."""
    col = list(range(len(pattern) + 1))
    best = (col[-1], 0)
    for at, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(col[i] + 1, new[i - 1] + 1, col[i - 1] + (p != c)))
        col = new
        best = min(best, (col[-1], at), key=lambda x: x[0])
    return best


def test_myers_is_the_table():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        want = distances(p, t)
        assert decontam.myers(p, t, 200) == want
        assert decontam.myers(p, t, want[0] - 1) is None


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        i, kind = rng.randrange(len(s)), rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("xyz")
        elif kind == 1:
            s.insert(i, rng.choice("xyz"))
        else:
            del s[i]
    return "".join(s)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40)))) for i in range(20)] + [(20, None), (21, ""), (22, " .,! "), (23, "solo")]
    docs = []
    for i in range(80):
        body = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            item = rng.choice(items[:20])[1]
            n = len(decontam.normal(item))
            body.insert(rng.randint(0, len(body)), edited(rng, item, rng.randint(0, n // 20 + 2)).upper())
        docs.append((i, " ".join(body)))
    docs += [(90, None), (91, ""), (92, "a solo, here"), (93, "soloist"), (94, "nothing " * 30_000 + items[0][1]), (94, items[0][1]), (None, items[1][1])]
    return docs, items


@pytest.mark.parametrize("block_chars", [1 << 20, 300])
def test_every_match_within_the_budget(spark, texts, block_chars):
    docs, items = texts
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, distance int, item_id string")
    b = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id int")
    got = decontam.contaminated(d, b, block_chars=block_chars)
    want = []
    for i, t in docs:
        for j, p in items:
            p, t_ = decontam.normal(p or ""), decontam.normal(t or "")
            if p and t_:
                k = decontam.budget(len(p))
                if i == 94 and len(t_) > 10_000:  # the table is too slow there
                    hit = (0, len(t_)) if t_.endswith(p) else None
                else:
                    hit = distances(p, t_)
                if hit and hit[0] <= k:
                    want.append((str(i), j, hit[0]))
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in got.collect()) == sorted(want)
    assert len(want) > 30
    bad = {w[0] for w in want}
    kept = decontam.drop_contaminated(d, b, block_chars=block_chars)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if str(i) not in bad)


def test_no_items_or_no_documents(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(d, b).count() == 0 and decontam.drop_contaminated(d, b).count() == 1
    assert decontam.contaminated(d.limit(0), spark.createDataFrame([(1, "a")], b.schema)).count() == 0


# ---------------------------------------------------------------- model scoring


def plain_scores(docs, target):
    c, ct = collections.Counter(), collections.Counter()
    seqs = [["<s>", *(t or "").lower().split(), "</s>"] for _, t in docs]
    for (i, _), s in zip(docs, seqs):
        for count in [c] + [ct] * (i in target):
            count.update([("w", "<s>")])
            count.update(("w", w) for w in s[1:])
            count.update(zip(s, s[1:]))
    n = sum(len(s) - 1 for s in seqs)
    nt = sum(len(s) - 1 for (i, _), s in zip(docs, seqs) if i in target)
    out = []
    for s in seqs:
        a = b = 0.0
        for v, w in zip(s, s[1:]):
            base = c["w", w] / n
            own = lmscore.WORD * ct["w", w] / nt + (1 - lmscore.WORD) * base if nt else base
            mix = lambda k, p: lmscore.PAIR * k[v, w] / k["w", v] + (1 - lmscore.PAIR) * p if k["w", v] else p
            a, b = a - math.log(mix(ct, own)), b - math.log(mix(c, base))
        out.append((len(s) - 1, round(a / (len(s) - 1), 9), round(b / (len(s) - 1), 9)))
    return out


@pytest.mark.parametrize("chunk, sent", [(1 << 24, 1000), (200, 0)])
def test_scores_are_the_definition(spark, monkeypatch, chunk, sent):
    monkeypatch.setattr(lmscore, "SENT_IDS", sent)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(("The", "the", "cat", "dog", "é", "runs")) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, " \n"), (5, docs[5][1]), (None, "the cat"), (63, "word " * 3000)]
    for target in ({1, 2, 5, 63, 777}, set()):
        df = spark.createDataFrame([(*r, 1.0, True) for r in docs], "doc_id long, text string, score double, is_target boolean").repartition(3)
        t = spark.createDataFrame([(i, "x") for i in [*target, None]], "doc_id long, text string")
        got = lmscore.cross_entropy_difference(df, t, chunk_bytes=chunk, bucket_bytes=100)
        want = sorted((str(i), *s) for (i, _), s in zip(docs, plain_scores(docs, target)))
        assert sorted((str(r.doc_id), r.tokens, round(r.target_loss, 9), round(r.background_loss, 9)) for r in got.collect()) == want
    assert lmscore.cross_entropy_difference(df.limit(0), t).count() == 0


def test_whole_table_against_the_definition(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in entry.queries()["op2_cross_entropy_difference"](spark, sf).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    for (i, _), (n, a, b) in zip(docs, plain_scores(docs, target)):
        assert got[i].tokens == n and abs(got[i].target_loss - a) < 1e-8 and abs(got[i].score - (a - b)) < 1e-8


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    left = {r.doc_id for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == names
        now = {r.doc_id for r in docs.collect()}
        assert now <= left and len(now) > 0.5 * len(left), name
        left = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in out.collect()} == left
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, ran.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, out.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_pipeline_on_odd_rows(spark, tmp_path):
    sf = str(tmp_path)
    shutil.copy("/root/testdata/sf0.001/benchmark.parquet", os.path.join(sf, "benchmark.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", F.lit("x").alias("score"), F.lit(1).alias("fp"))
    odd = [(1000, None, None, None, None, "x", 1), (1001, "", "en", "s", 0, "x", 1), (1002, "12 34", "en", "s", 5, "x", 1), (1003, f"so it said {item} and more", "en", "s", 1, "x", 1), (None, "a text without an id but with words of its own", "en", "s", 1, "x", 1)]
    spark.createDataFrame([*[tuple(r) for r in docs.collect()], *odd, tuple(docs.first())], docs.schema).write.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).select("doc_id", "piece").collect()
    ids = [r.doc_id for r in got]
    assert not {1000, 1001, 1002, 1003} & set(ids) and None in ids
    assert len(set(map(tuple, got))) == len(got)  # the repeated row is gone
    spark.createDataFrame([], docs.schema).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0

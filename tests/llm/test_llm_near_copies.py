"""Near copies by Jaccard similarity against brute force."""

import random

import corpus_pipeline
from barspark.llm import nearcopies


def plain_set(text):
    words = (text or "").split()
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(texts):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if like(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def corpus():
    """Stars whose edges only meet in the centre, chains whose ends differ, halves that are shared, and short texts."""
    rng, word = random.Random(4), lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", " ", "two words", "two  words", "four words are here"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 200))]
        star = []
        for _ in range(10):
            x = list(base)
            for at in rng.sample(range(len(x)), len(x) // 45):
                x[at] = word()
            star.append(" ".join(x))
        chain, x = [], list(base[::-1])
        for _ in range(6):
            at = rng.randrange(len(x))
            x = x[:at] + [word() for _ in range(4)] + x[at + 4:]
            chain.append(" ".join(x))
        texts += [*star, " ".join(base), *chain, " ".join(base[:len(base) // 2] + [word() for _ in range(60)])]
    rng.shuffle(texts)
    return texts


def test_stage_keeps_one_of_each_group(spark):
    texts = corpus()
    want = brute(texts)
    assert 20 < len(set(want)) < len(texts) - 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == sorted(set(want))


def test_ids_do_not_matter(spark):
    texts = corpus()
    docs = spark.createDataFrame([(None if i % 3 == 0 else 5 if i % 3 == 1 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.text for r in nearcopies.drop_near_copies(docs).collect()]
    want = brute(texts)
    of = {t: w for t, w in zip(texts, want)}
    assert sorted(of[t] for t in got) == sorted(set(want))


def test_empty(spark):
    assert nearcopies.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def star(copies, seed=9):
    """Copies of one text with 0 to 5 % of the words changed, most of them below the similarity of each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = []
    for i in range(copies):
        x = list(base)
        for at in rng.sample(range(len(x)), 15 * i // copies):
            x[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(x))
    rng.shuffle(texts)
    return texts


def test_pairs_grow_with_the_copies_not_their_square(spark, monkeypatch):
    verified, made = nearcopies._verified, []

    def counted(pairs, *more):
        made.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(nearcopies, "_verified", counted)
    texts = star(300)
    want = sorted(set(brute(texts)))
    assert 50 < len(want) < 250
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.drop_near_copies(docs).collect()) == want
    assert made[0] < 4 * 300 and made[1] < 30, made

"""Golay near-duplicates against brute force, and the component search."""

import random

import numpy as np
import xxhash

from barspark.llm import golay
from barspark.llm.common import components

SCHEMA = "doc_id long, text string, fp string, key long, component_id string, node int"  # the last four clash with inner names


def rows(texts, first=0):
    return [(first + i, t, "x", 1, "y", 2) for i, t in enumerate(texts)]


def plain_simhash(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, w = [], ""
    for c in lowered + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            if w:
                words.append(w)
            w = ""
        else:
            w += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_definition():
    rng = random.Random(1)
    texts = ["", " \t\n\x0b\x0c\r ", "One", "ONE two", "a b c", "A b c d\x1ce", "É ß Ünï CODE \U0001f600 x", "a b c " * 5]
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 60))) for _ in range(50)]
    for t in texts:
        assert golay.simhash(t) == plain_simhash(t), t


def test_long_text_in_chunks():
    t = " ".join(str(i % 977) for i in range(golay.CHUNK + 5_000))
    assert golay.simhash(t) == plain_simhash(t)


def test_code_is_perfect_and_keys_meet():
    index, words = golay.golay_tables()
    assert min(bin(int(w)).count("1") for w in words[1:]) == 7
    assert (np.bincount(index, minlength=4096) == 2048).all()
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 300).astype(np.uint64)
    for a, keys in zip(fp, golay.keys_of(fp)):
        i, j = rng.choice(64, 2, replace=False)
        b = a ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j))
        assert set(keys) & set(golay.keys_of(np.array([b]))[0])
        assert len(keys) <= 16


def brute(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_links_connect_what_is_near(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(30):  # chains, stars and single ones
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.append(x)
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            if rng.random() < 0.2:
                x ^= 1 << rng.randrange(64)
    fps = list(dict.fromkeys(fps))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    got = {r.node: r.root for r in components(golay.links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    want = brute(fps)
    part = {}
    for i, s in enumerate(signed):
        part.setdefault(want[i], set()).add(got.get(s, s))
    assert all(len(p) == 1 for p in part.values())
    assert len({next(iter(p)) for p in part.values()}) == len(part)


def test_documents(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here into the deep green wood at night " * 4
    texts = [None, base, "", base.upper(), base + "end", "something else entirely written about other things", base, "   "]
    df = spark.createDataFrame(rows(texts, 10) + [(11, base, "x", 1, "y", 2), (None, "only here", "x", 1, "y", 2)], SCHEMA)
    got = golay.near_duplicates(df).collect()
    assert len(got) == len(texts) + 2
    fp = {i: plain_simhash(t or "") for i, t in enumerate(texts, 10)}
    ids = sorted(fp)
    want = {i: ids[r] for i, r in zip(ids, brute([fp[i] for i in ids]))}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = golay.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*{want[i] for i in ids}, None], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert golay.near_duplicates(df).count() == 0 and golay.drop_near_duplicates(df).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(1, j) for j in range(2, 60)] + [(5, 5), (None, 7)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 1 for i in range(1, 60)}}

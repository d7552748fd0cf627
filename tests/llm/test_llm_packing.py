"""Tokens, minimum bin slack and places."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from barspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, piece string, start int, length string, sequence_id int, offset int, _bucket int"


def rows(pairs):
    return [(i, t, "a", 1, "b", 2, 3, 4) for i, t in pairs]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_word_by_word_is_the_tokenizer(tokenizer):
    texts = ["", " ", "It's don't we'll ''s !'s 'so x?! hi! a. .", "İstanbul ΣΑΣ ς", "a\x1cb\x85c d e　f", "<|endoftext|>x <|startoftext|>", "é é ﬁ ½ ² 12345 日本語 한글 हिन्दी",
             "zero​width ‍join", "x" * 5000, "Word word, WORD; word. word"]
    rng = random.Random(4)
    texts += ["".join(rng.choice("ab.,'! é1\n") for _ in range(200)) for _ in range(50)]
    words = packing.WordTokens(PATH)
    for t in texts:
        assert np.frombuffer(words.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_cache_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 10)
    words = packing.WordTokens(PATH)
    for i in range(30):
        t = " ".join(f"w{i * j}" for j in range(7))
        assert np.frombuffer(words.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert len(words.known) < 30


def test_fullest_is_the_best_subset():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        left = rng.randint(0, 60)
        got = packing.fullest(left, sorted(counts, reverse=True), counts)
        items = [n for n, c in counts.items() for _ in range(c)]
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= left)
        assert sum(n * k for n, k in got) == best and all(k <= counts[n] for n, k in got)


def test_patterns_use_every_item_once():
    rng = random.Random(7)
    h = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(60)}
    plan = packing.patterns(h, 100)
    used = {}
    for times, items in plan:
        assert sum(n * k for n, k in items) <= 100
        for n, k in items:
            used[n] = used.get(n, 0) + n * 0 + k * times
    assert used == h
    bins, least = sum(t for t, _ in plan), -(-sum(n * c for n, c in h.items()) // 100)
    assert least <= bins <= 1.05 * least  # lengths up to the whole capacity leave slack in any packing
    small = packing.patterns({n: c for n, c in h.items() if n <= 30}, 100)
    assert sum(t for t, _ in small) == -(-sum(n * c for n, c in h.items() if n <= 30) // 100)
    assert packing.patterns({}, 100) == []
    with pytest.raises(ValueError):
        packing.patterns({101: 1}, 100)


def test_documents(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)  # several numbering buckets
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(rng.randint(0, 40))) for i in range(60)} | {100: None, 101: "", 102: "word " * 500}
    pairs = [*texts.items(), (3, texts[3]), (None, "no id")]
    df = spark.createDataFrame(rows(pairs), SCHEMA)
    got = packing.pack_documents(df, PATH, capacity=64).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in pairs}
    want = sorted((str(i), k, at, len(ids[i][at:at + 64]), zlib.crc32(np.array(ids[i][at:at + 64], "<u4").tobytes())) for i, _ in pairs for k, at in enumerate(range(0, len(ids[i]), 64)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 1


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_words_and_pieces_share_one_memory(tokenizer):
    """Ids are the tokenizer's own whatever was met first, and the vocabulary is read again only for a text that needs it whole."""
    words = packing.WordTokens(PATH)
    texts = ["it's, it 's ''s '' ' , ;", "s' 's it , abc,, abc, abc abc1 1 12 a1b", "Été, été été. é́ ñandú! |", "abc's '", " x y　z", ""]
    for t in [*texts, *reversed(texts)]:
        assert words.encode(t) == np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert words.whole is None
    t = "a <|endoftext|> b"
    assert words.encode(t) == np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() and words.whole is not None

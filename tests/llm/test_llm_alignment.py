"""Alignment of two tokenizers against a walk over both token lists."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from barspark.llm import crosstok

LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, "a", " a", "  a  b\n\n  c", "▁a", "x ▁", "<|endoftext|> </s><s>", "naïve Ωμέγα 漢字 \U0001f600\U0001f600", "\x00\x01", "don't  we'll 12345 67", "a" * 3000, "word " * 20_000, "﻿q​", "<0x41>", "\r\n\t"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return TEXTS + ["".join(rng.choice(["a", "the ", " ", "é", "漢", "1", ".", "\n", "'s", "ing", "<", "\U0001f9ea"]) for _ in range(rng.randint(1, 60))) for _ in range(200)] + ["same text again"] * 5


def walked(texts):
    """Figures per text by walking both lists; the reference tokenizer file itself, not its ranks."""
    a_side, b_side = Tokenizer.from_file(LEFT), sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    a_side.encode_special_tokens = True
    a_bytes, b_bytes = crosstok.byte_level(LEFT).token, crosstok.pieces(RIGHT).token
    total, parts = Counter(), []
    for t in texts:
        a, b = (a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)) if t else ([], [])
        raw = (" " + (t or "")).encode()
        if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            parts.append(None)
            continue
        owner = [[i for i, x in enumerate(ids) for _ in side[x]] for ids, side in ((a, a_bytes), (b, b_bytes))]
        links = sorted(set(zip(*owner)))
        ends = [set(np.cumsum([len(side[x]) for x in ids]).tolist()) for ids, side in ((a, a_bytes), (b, b_bytes))]
        groups, at = [], 0
        for cut in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(ids[i]) for i in sorted(set(own[at:cut]))) for ids, own in ((a, owner[0]), (b, owner[1]))))
            at = cut
        ids = [(a[i], b[j]) for i, j in links]
        total.update(ids)
        parts.append((len(a), len(b), len(groups), ids, ";".join(groups)))
    high = {}
    for (_, y), n in total.items():
        high[y] = max(high.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "", "") if p is None else (p[0], p[1], p[2], len(p[3]), sum(total[x] == high[x[1]] for x in p[3]), sum(total[x] for x in p[3]), hashlib.sha256(p[4].encode()).hexdigest(), p[4])
            for p in parts]


@pytest.mark.parametrize("chunk_bytes", [1, 500, crosstok.CHUNK_BYTES])
def test_against_walk(spark, texts, chunk_bytes):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, chunk int").withColumns({"pairs": F.lit(1), "place": F.lit("x")}).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in crosstok.alignment(df, LEFT, RIGHT, chunk_bytes=chunk_bytes).collect()}
    want = walked(texts)
    assert got == {i: w[:7] for i, w in enumerate(want)}
    assert {r.doc_id: r.groups for r in crosstok.groups(df, LEFT, RIGHT).collect()} == {i: w[7] for i, w in enumerate(want)}


def test_null_and_repeated_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (3, "a b"), (3, "a b")], "doc_id long, text string")
    got = crosstok.alignment(df, LEFT, RIGHT).collect()
    assert sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in got) == [(0, 0, 0), (0, 2, 6), (3, 2, 6), (3, 2, 6)]
    assert crosstok.alignment(df.where("doc_id > 9"), LEFT, RIGHT).count() == 0


def test_chain_of_overlaps():
    """A component of n tokens needs about log2(n) doublings; all get its last token."""
    n = 5000
    a, b = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n - 1, 2), 2 * n)
    assert set(crosstok.terminal_of(a, b).tolist()) == {len(a) + len(b) - 1}
    one = np.arange(1, n)
    assert crosstok.terminal_of(one, one).tolist() == list(range(n - 1, 2 * (n - 1))) * 2

"""Alignment of two tokenizers over the same bytes, by pointer jumping.

Both tokenizers cover the bytes of a text without gaps, so tokens are byte ranges. Every token points to the token
that reaches farthest right among itself and those of the other side that overlap it. Doubling these pointers (each step
replaces the successor by its successor's successor, for all tokens of a slice of documents at once) ends at the last
token of each connected group, whose name labels the group: the ranges between offsets where both sides end.

Links are the overlapping pairs of tokens. How often two ids are linked counts over the whole corpus: a chunk of documents sends each
of its distinct id pairs once with its count, and gets back that pair's total and whether it is the highest of its second id.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import pick, stage, text_slices

CHUNK_BYTES = 4 << 20
# ---- fixed values: the byte-level split, and what its vocabulary writes bytes as
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))
# ---- end of fixed values


# ---------------------------------------------------------------- tokenizers


def byte_letters() -> dict[str, int]:
    """Letter to byte: a plain byte is written as its own code point, the others, in order, as those from 256 on."""
    others = [b for b in range(256) if b not in PLAIN_BYTES]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizer(NamedTuple):
    encode: object  # text -> ids
    token: list  # id -> bytes
    size: np.ndarray  # id -> number of bytes


@lru_cache(maxsize=4)
def byte_level(path: str) -> Tokenizer:
    """Byte-level BPE of a tokenizers file, run by tiktoken: ids in the order of the merges are its ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"] if t["special"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merged = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    order = [spec["model"]["vocab"][m.replace(" ", "")] for m in merged]
    if order != sorted(order):
        raise ValueError("ids must follow the order of the merges")
    token = [b""] * (max(spec["model"]["vocab"].values()) + 1)
    for t, i in ranks.items():
        token[i] = t
    own = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer(lambda text: own.encode_ordinary(" " + text), token, np.array([len(t) for t in token], np.int64))


@lru_cache(maxsize=4)
def pieces(path: str) -> Tokenizer:
    """A sentencepiece model, which adds the leading space itself."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    token = [bytes([int(n[3:5], 16)]) if own.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return Tokenizer(lambda text: own.encode(text), token, np.array([len(t) for t in token], np.int64))


# ---------------------------------------------------------------- alignment


class Slice(NamedTuple):
    """Tokens of several documents one after the other; ``na``, ``nb`` are their numbers per document."""
    a: np.ndarray
    b: np.ndarray
    na: np.ndarray
    nb: np.ndarray


def tokens_of(texts: list[str], left: Tokenizer, right: Tokenizer) -> Slice:
    """Ids of both sides; none for a text that is empty or whose joined tokens are not its bytes."""
    a, b = [], []
    for t in texts:
        raw = (" " + t).encode()
        x, y = (left.encode(t), right.encode(t)) if t else ((), ())
        same = b"".join([left.token[i] for i in x]) == raw and b"".join([right.token[i] for i in y]) == raw
        a.append(np.array(x if same else (), np.int64))
        b.append(np.array(y if same else (), np.int64))
    whole = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b)]
    return Slice(*whole, np.array([len(v) for v in a], np.int64), np.array([len(v) for v in b], np.int64))


def terminal_of(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Per token (first all of a, then all of b) the last token of its connected group, as a place in that list.

    ``end_a`` and ``end_b`` are ascending byte offsets with the same last one. A token points to the overlapping token
    that ends last, b's at equal ends; the last token of a group points to itself.
    """
    na = len(end_a)
    start_a, start_b = np.concatenate(([0], end_a[:-1])), np.concatenate(([0], end_b[:-1]))
    to_b = np.searchsorted(start_b, end_a, "left") - 1 + na
    to_a = np.searchsorted(start_a, end_b, "left") - 1
    own = np.arange(na, na + len(end_b))
    succ = np.concatenate((to_b, np.where(end_a[to_a] > end_b, to_a, own))) if na else own
    while True:
        after = succ[succ]
        if np.array_equal(after, succ):
            return succ
        succ = after


class Aligned(NamedTuple):
    group_a: np.ndarray  # group number of every a token, counted over the slice
    group_b: np.ndarray
    link_a: np.ndarray  # places of the linked tokens, in byte order
    link_b: np.ndarray


def align(s: Slice, left: Tokenizer, right: Tokenizer) -> Aligned:
    end_a, end_b = np.cumsum(left.size[s.a]), np.cumsum(right.size[s.b])
    last = terminal_of(end_a, end_b)
    number = np.cumsum(last[len(s.a):] == np.arange(len(s.a), len(last))) - 1  # terminals are b tokens, in order
    group = number[last - len(s.a)]
    first = np.searchsorted(end_b, np.concatenate(([0], end_a[:-1])), "right") if len(s.a) else np.zeros(0, np.int64)
    many = last_overlap(end_a, end_b) - first + 1
    link_a = np.repeat(np.arange(len(s.a)), many)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return Aligned(group[:len(s.a)], group[len(s.a):], link_a, link_b)


def last_overlap(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Per a token the last b token that overlaps it."""
    return np.searchsorted(np.concatenate(([0], end_b[:-1])), end_a, "left") - 1 if len(end_a) else np.zeros(0, np.int64)


def group_texts(s: Slice, g: Aligned) -> list[bytes]:
    """Per document ``a1,a2|b1;a3|b2,b3``: a's and b's ids of each group in order; empty without tokens."""
    n = len(s.a) + len(s.b)
    groups = int(g.group_b[-1]) + 1 if len(s.b) else 0
    at_a = np.arange(len(s.a)) + np.searchsorted(g.group_b, g.group_a, "left")
    at_b = np.arange(len(s.b)) + np.searchsorted(g.group_a, g.group_b, "right")
    ids, mark = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[at_a], ids[at_b] = s.a, s.b
    if groups:
        mark[at_a[np.searchsorted(g.group_a, np.arange(groups), "right") - 1]] = ord("|")
        mark[at_b[np.searchsorted(g.group_b, np.arange(groups), "right") - 1]] = ord(";")
    digits = np.ones(n, np.int64)
    for k in range(1, 7):
        digits += ids >= 10**k
    rows = np.zeros((n, 8), np.uint8)
    rest = ids.copy()
    for k in range(7):  # right-aligned before the mark
        rows[:, 6 - k] = rest % 10 + 48
        rest //= 10
    rows[:, 7] = mark
    flat = rows[np.arange(8)[None, :] >= (7 - digits)[:, None]].tobytes()
    ends = np.concatenate(([0], np.cumsum(digits + 1)))
    doc = np.concatenate(([0], np.cumsum(s.na + s.nb)))
    return [flat[ends[i]:max(ends[i], ends[j] - 1)] for i, j in zip(doc[:-1], doc[1:])]


# ---------------------------------------------------------------- tables


def groups(docs: DataFrame, left: str, right: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, groups): every document's aligned groups as text, empty where it has no tokens."""
    x = pick(docs, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(left), pieces(right)
        for part, texts in text_slices(batches, slice_bytes=CHUNK_BYTES):
            s = tokens_of(texts, a, b)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.decode() for t in group_texts(s, align(s, a, b))], pa.string())], ["doc_id", "groups"])

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, groups string")


_PER_DOC = ("n_a", "n_b", "n_groups", "n_links")


def _chunks(docs: DataFrame, left: str, right: str, chunk_bytes: int) -> DataFrame:
    """One row per chunk of documents: their figures, the links as places in the chunk's list of id pairs, that list and its counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(left), pieces(right)
        first = TaskContext.get().partitionId() << 32
        for number, (part, texts) in enumerate(text_slices(batches, slice_bytes=chunk_bytes)):
            s = tokens_of(texts, a, b)
            g = align(s, a, b)
            doc_a, doc_b = (np.repeat(np.arange(len(texts)), n) for n in (s.na, s.nb))
            ends = np.flatnonzero(np.diff(g.group_b, append=-1)) if len(g.group_b) else np.zeros(0, np.int64)
            figures = [s.na, s.nb, np.bincount(doc_b[ends], minlength=len(texts)), np.bincount(doc_a[g.link_a], minlength=len(texts))]
            pairs, place, times = np.unique(s.a[g.link_a] * len(b.size) + s.b[g.link_b], return_inverse=True, return_counts=True)
            sha = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(s, g)]
            whole = pa.array([0, len(texts)], pa.int32())
            cols = [pa.array([first + number]), pa.ListArray.from_arrays(whole, part.column(0)), *[pa.array([f], pa.list_(pa.int64())) for f in figures],
                    pa.array([sha], pa.list_(pa.string())), pa.array([zstandard.ZstdCompressor(level=1).compress(place.astype("<u4").tobytes())], pa.binary()),
                    pa.array([pairs], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["chunk", "doc_id", *_PER_DOC, "sha", "links", "pairs", "times"])

    figures = ", ".join(f"{c} array<bigint>" for c in _PER_DOC)
    return docs.mapInArrow(run, f"chunk bigint, doc_id array<{kind}>, {figures}, sha array<string>, links binary, pairs array<bigint>, times array<bigint>")


def pair_counts(chunks: DataFrame, right_size: int) -> DataFrame:
    """(pair, n, best): links of each id pair in the corpus, and whether no other pair of its right id has more."""
    counts = chunks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    counts = stage(counts)
    high = counts.groupBy((F.col("pair") % right_size).alias("right")).agg(F.max("n").alias("high"))  # one row per id of the right vocabulary at most
    x = counts.withColumn("right", F.col("pair") % right_size).join(F.broadcast(high), "right")
    return x.select("pair", "n", (F.col("n") == F.col("high")).alias("best"))


def alignment(docs: DataFrame, left: str, right: str, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per input row.

    ``left`` is a byte-level tokenizers file, ``right`` a sentencepiece model; special tokens are plain text. Texts that are null, empty
    or not the joined bytes of both sides' tokens have zeros and an empty string. Ids may be null or repeated, other columns take no
    part, an empty table gives no rows. A task holds ``chunk_bytes`` of text, or one longer text, and its tokens.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    size = len(pieces(right).size)
    made = stage(_chunks(pick(docs, doc_id=doc_id, text=text), left, right, chunk_bytes))
    listed = made.select("chunk", F.posexplode("pairs").alias("place", "pair")).join(pair_counts(made, size), "pair")
    listed = listed.select(F.col("chunk").alias("of"), "place", "n", "best")

    def finish(one: pa.Table, known: pa.Table) -> pa.Table:
        row = {c: one.column(c)[0] for c in one.column_names if c != "chunk"}
        at = known.column("place").to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = known.column("n").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
        place = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["links"].as_py()), "<u4")
        links = row["n_links"].values.to_numpy()
        edge = np.concatenate(([0], np.cumsum(links)))
        total, best = (np.concatenate(([0], np.cumsum(v[place])))[edge] for v in (n, best))
        cols = [row["doc_id"].values, *[row[c].values for c in _PER_DOC], pa.array(np.diff(best), pa.int64()), pa.array(np.diff(total), pa.int64()), row["sha"].values]
        return pa.Table.from_arrays(cols, ["doc_id", *_PER_DOC, "n_best", "count_sum", "groups_sha256"])

    out = ", ".join(f"{c} bigint" for c in (*_PER_DOC, "n_best", "count_sum"))
    return made.drop("pairs", "times").groupBy("chunk").cogroup(listed.groupBy("of")).applyInArrow(finish, f"doc_id {kind}, {out}, groups_sha256 string")

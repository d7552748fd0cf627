"""Best-fit packing of documents into sequences by minimum bin slack.

Only lengths matter to packing, and there are at most ``capacity`` of them. The driver gets the histogram of lengths
(one number per length), never the documents. Minimum bin slack then fills one bin at a time: the largest length left is
taken, a bitset subset-sum over the lengths left finds the fullest combination with it, and that combination is
removed - as often as the counts allow, since it stays the fullest until one of its lengths runs out. So the plan
has about as many patterns as there are lengths, for any number of documents.

Pieces find their place by their number within their length: (length, bucket) counts give the offset of a bucket, the
number within the bucket is a window over a bounded group, and a lookup of that number in the plan gives
sequence and offset.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barspark.llm.common import pick, stage, text_slices

CAPACITY = 2048
BUCKET_ROWS = 20_000  # pieces of one length numbered in one window group
CACHE_WORDS = 500_000  # pieces of text and their words whose ids a worker remembers before it forgets all of them
PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokens


class WordTokens:
    """Ids of whole texts as little-endian 32-bit bytes; equal to the tokenizer's own, word by word through a cache.

    The tokenizer's rules never join characters across white space, so the normalised text may be cut there and
    each distinct piece encoded once: pieces not seen before are cut into the tokenizer's words, whose last token is one with
    the word-end suffix, so that many words go through one call. A word that stands alone is a piece, so both are remembered in one place. Texts in which cutting first could matter (special
    token strings, a capital sigma, separators that only Python takes for white space) go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer, normalizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.path, self.whole = path, None
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_in = regex.compile(cut).findall
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for w, i in spec["model"]["vocab"].items() if w.endswith(suffix)]] = True
        self.odd = [t["content"] for t in spec["added_tokens"]] + ["\u03a3", "\x1c", "\x1d", "\x1e", "\x1f"]
        self.known: dict[str, bytes] = {}

    def _as_it_is(self, text: str) -> bytes:
        from tokenizers import Tokenizer

        self.whole = self.whole or Tokenizer.from_file(self.path)
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.odd):
            return self._as_it_is(text)
        parts = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        got = list(map(known.get, parts))
        if None in got:
            new = dict.fromkeys([p for p, g in zip(parts, got) if g is None])
            cut = {p: (p[:-1], p[-1]) if p[:-1].isalpha() and p[-1] in ".,;:?!|" else self.words_in(p) for p in new if not p.isalpha()}
            missing = [p for p in new if p not in cut]
            missing = list(dict.fromkeys(missing + [w for c in cut.values() for w in c if w not in known]))
            if missing:
                ids = np.asarray(self.plain.encode_batch_fast([" ".join(missing)], add_special_tokens=False)[0].ids, "<u4")
                raw, at = ids.tobytes(), 0
                for w, end in zip(missing, ((np.nonzero(self.ends[ids])[0] + 1) * 4).tolist(), strict=True):
                    known[w] = raw[at:end]
                    at = end
            for p, c in cut.items():
                known[p] = b"".join([known[w] for w in c])
            got = [g if g is not None else known[p] for p, g in zip(parts, got)]
        return b"".join(got)


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker process and vocabulary, so that its cache outlives a task."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and a closing id 0, cut only if longer than ``capacity``.

    A null or empty text is the closing id alone: one piece of length 1.
    """
    x = pick(docs, doc_id=doc_id, text=text)
    kind = x.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer)
        for part, texts in text_slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(texts):
                ids = words.encode(t) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at:at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return x.mapInArrow(run, PIECES.format(kind=kind))


# ---------------------------------------------------------------- the plan


def fullest(left: int, lengths: list[int], counts: dict[int, int]) -> list[tuple[int, int]]:
    """[(length, copies)] with the largest sum of at most ``left``; the longer lengths are tried first.

    Bit s of ``reach`` says that s can be made of the lengths looked at so far, each used as often as it is there.
    """
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for n in lengths:
        if n > left:
            continue
        before, most, step = reach, min(counts[n], left // n), 1
        while most > 0:  # doubling: 1, 2, 4 ... copies at a time, then the rest
            take = min(step, most)
            reach |= (reach << (take * n)) & mask
            most -= take
            step *= 2
        if reach != before:
            steps.append((n, before))
            if reach >> left & 1:
                break
    at, used = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        k = 0
        while not before >> at & 1:
            at -= n
            k += 1
        if k:
            used.append((n, k))
    return used


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over a histogram: [(number of bins, [(length, copies)])], each bin's lengths from the longest."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        used = dict(fullest(capacity - top, lengths if counts[top] else lengths[1:], counts))
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
        lengths = [n for n in lengths if counts[n]]
        out.append((times, sorted(used.items(), reverse=True)))
    return out


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, runs of its pieces: first number, copies per bin, first sequence, first offset in the bin."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    placed: dict[int, int] = {}
    sequence = 0
    for times, used in plan:
        offset = 0
        for n, k in used:
            runs.setdefault(n, []).append((placed.get(n, 0), k, sequence, offset))
            placed[n] = placed.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in runs.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to staged rows that have a length from 1 to ``capacity``.

    Offsets within a sequence start at 0 and leave no gap. Rows of equal length are interchangeable; repeated rows are
    placed one by one. ``parts`` should be a written table, since the counts and the rows must agree.
    """
    # equal rows are numbered as one with a count, and a bucket is decided by the row: no bucket is large, and a lost task that is computed again finds the same numbers
    rows = stage(parts.groupBy(*parts.columns).agg(F.count(F.lit(1)).alias("_n")))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*parts.columns), F.lit(max(1, -(-rows.count() // BUCKET_ROWS)))))
    counts = rows.groupBy(length, "_bucket").agg(F.sum("_n").alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy(length).agg(F.sum("_n")).collect()}  # one row per length
    before = Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(length, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(length, "_bucket").orderBy(*[c for c in parts.columns if c != length]).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("_last", F.sum("_n").over(inside)).join(offsets, [length, "_bucket"])
    first = F.col("_before") + F.col("_last") - F.col("_n")
    numbered = numbered.withColumn("_number", F.explode(F.sequence(first, first + F.col("_n") - 1)))
    table, names = places(patterns(histogram, capacity)), parts.columns
    schema = StructType([*parts.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, number = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, "_number"))
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for one in np.unique(n):
                at = np.nonzero(n == one)[0]
                first, copies, sequence, offset = table[int(one)]
                run_ = np.searchsorted(first, number[at], "right") - 1
                k = number[at] - first[run_]
                seq[at] = sequence[run_] + k // copies[run_]
                off[at] = offset[run_] + k % copies[run_] * one
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in names], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return numbered.select(*parts.columns, "_number").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents as pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Empty tables give no rows; null texts are the closing id; ids may be null or repeat.
    """
    return pack(stage(pieces(docs, tokenizer, capacity, doc_id, text)), capacity)

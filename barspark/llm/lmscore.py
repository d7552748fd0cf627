"""Cross-entropy difference of documents under two n-gram models that share one vocabulary.

The background model counts words and word pairs of all documents, the target model those of the target documents.
Both are interpolated bigram models over the same words, with the same weights:

    background  p(w)     = c(w) / N                                 p(w | v) = PAIR c(v w) / c(v) + (1 - PAIR) p(w)
    target      p_t(w)   = WORD c_t(w) / N_t + (1 - WORD) p(w)       p_t(w | v) = PAIR c_t(v w) / c_t(v) + (1 - PAIR) p_t(w)

Every word of a scored document is in the background, so no probability is zero. Texts have a start, which is a context only, and
an end, which is a word; an unseen context leaves its weight to p. The score is the mean over a document's tokens of target
loss minus background loss (nats): the lower, the nearer to the target.

Counts that fit no machine are kept apart by hash: documents are counted in chunks of bounded size, each chunk's distinct keys (64-bit
hashes of words and pairs) go with their counts to the bucket of the key, buckets add up the chunks' counts and send back to
each chunk the totals that differ from its own, and the chunk is scored with its texts, which are read once more. So a key
crosses the network once per chunk, however often it occurs, and no task holds more than a chunk or a bucket. A chunk is a
slice of a partition of the input; both reads must cut it alike, so the input has to be a table (or plan) with fixed partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import pick, stage, text_slices

PAIR, WORD = 0.7, 0.9
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 64
SENT_IDS = 2_000_000  # the most target ids that are sent to every executor
START, END = 0, 1
SPLIT = r"[^\t-\r ]+"  # words as bytes.split() finds them


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8").split()


class Chunk:
    """Distinct keys of some texts and where they occur. Everything is made from the texts alone, so it can be made again."""

    def __init__(self, texts: list[str], target: np.ndarray, buckets: int) -> None:
        known: dict[bytes, int] = {}
        ids = [np.array([START, *[known.setdefault(w, len(known) + 2) for w in words_of(t)], END], np.int64) for t in texts]
        h = xxhash.xxh64_intdigest
        word = np.array([1, 2, *[h(w, 0) for w in known]], np.uint64)
        length = np.array([len(i) - 1 for i in ids])
        self.doc = np.repeat(np.arange(len(texts)), length)
        self.tokens = length
        before = np.concatenate([i[:-1] for i in ids]) if ids else np.zeros(0, np.int64)
        self.word = np.concatenate([i[1:] for i in ids]) if ids else np.zeros(0, np.int64)
        pair, self.pair = np.unique(before * len(word) + self.word, return_inverse=True)
        self.first, self.second = pair // len(word), pair % len(word)
        with np.errstate(over="ignore"):
            x = word[self.first] * np.uint64(0x9E3779B97F4A7C15) + (word[self.second] << np.uint64(31) | word[self.second] >> np.uint64(33))
            x ^= x >> np.uint64(33)
            x *= np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(33)
        self.keys = np.concatenate((word, x))  # words, then pairs
        self.words = len(word)
        on = target[self.doc]
        self.counts = np.zeros((2, len(self.keys)), np.int64)  # background, target
        for row, weight in ((0, np.ones(len(self.doc))), (1, on.astype(float))):
            self.counts[row, :self.words] = np.bincount(self.word, weights=weight, minlength=self.words)
            self.counts[row, self.words:] = np.bincount(self.pair, weights=weight, minlength=len(pair))
        self.counts[:, START] = len(texts), int(target.sum())
        bucket = (self.keys % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((self.keys, bucket))
        self.edges = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def scores(self, totals: np.ndarray, n: float, n_target: float) -> tuple[np.ndarray, np.ndarray]:
        """Mean losses per document under target and background, from the whole corpus's counts of this chunk's keys."""
        def mixed(of_pair: np.ndarray, of_context: np.ndarray, p: np.ndarray) -> np.ndarray:
            seen = of_context > 0
            return np.where(seen, PAIR * of_pair / np.where(seen, of_context, 1) + (1 - PAIR) * p, p)

        base = totals[0, :self.words] / n
        own = WORD * totals[1, :self.words] / n_target + (1 - WORD) * base if n_target else base
        loss = [-np.log(mixed(totals[row, self.words:], totals[row, self.first], p[self.second])) for row, p in ((1, own), (0, base))]
        return tuple(np.bincount(self.doc, weights=x[self.pair], minlength=len(self.tokens)) / self.tokens for x in loss)


def _packed(a: np.ndarray) -> bytes:
    return zlib.compress(a.astype("<u4").tobytes() if a.max(initial=0) < 1 << 32 else b"8" + a.astype("<u8").tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    raw = zlib.decompress(b)
    return np.frombuffer(raw[1:], "<u8").astype(np.int64) if len(raw) % 4 == 1 else np.frombuffer(raw, "<u4").astype(np.int64)


def _packed_keys(sorted_keys: np.ndarray) -> bytes:
    """Differences of neighbours, highest bytes first: those are nearly all zero."""
    steps = np.diff(sorted_keys, prepend=np.uint64(0)).astype(">u8")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked_keys(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, tokens, target_loss, background_loss, score): one row per row of ``docs``.

    ``target`` has a column ``doc_id``: documents with these ids make up the target corpus (nulls never do). Null and empty texts
    are a start and an end. Without target documents both losses are equal. Counts cover all rows, repeated ones each time.
    """
    ids = stage(target.select("doc_id").where("doc_id is not null").distinct().withColumn("is_target", F.lit(True)))
    few = ids.count() <= SENT_IDS
    x = pick(docs, doc_id=doc_id, text=text).join(F.broadcast(ids) if few else ids, "doc_id", "left")
    x = x.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("is_target", F.lit(False)).alias("is_target"))
    return score_marked(x if few else stage(x), chunk_bytes, bucket_bytes)  # a shuffled join has no fixed partitions


def score_marked(x: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The same for (doc_id, text, is_target) rows; any storage that keeps the flag with the text saves the join."""
    size = F.regexp_count("text", F.lit(SPLIT)) + 1
    n, n_target, total = x.agg(F.sum(size), F.sum(F.when(F.col("is_target"), size)), F.sum(F.octet_length("text"))).first()
    n, n_target, buckets = float(n or 0), float(n_target or 0), max(LEAST_BUCKETS, -(-(total or 0) // bucket_bytes))
    kind = x.schema["doc_id"].dataType.simpleString()

    x = x.select("doc_id", "text", "is_target", F.spark_partition_id().alias("part"))
    schema, kinds = "bucket long, chunk long, body binary, n binary, n_target binary", (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[str]]]:
        for number, (part, texts) in enumerate(text_slices(batches, "text", chunk_bytes)):
            yield (part.column(3)[0].as_py() << 32) + number, part, texts

    def rows(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made), kinds)], ["bucket", "chunk", "body", "n", "n_target"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part, texts in chunks(batches):
            c = Chunk(texts, part.column(2).to_numpy(zero_copy_only=False).astype(bool), buckets)
            parts = ((b, c.order[c.edges[b]:c.edges[b + 1]]) for b in range(buckets))
            yield rows([(b, chunk, _packed_keys(c.keys[at]), _packed(c.counts[0, at]), _packed(c.counts[1, at])) for b, at in parts if len(at)])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part, _ in chunks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(part)
            yield rows([(-1, chunk, sink.getvalue().to_pybytes(), None, None)])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpacked_keys(b) for b in g["body"]]
        own = [np.concatenate([_unpacked(b) for b in g[c]]) for c in ("n", "n_target")]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = [np.bincount(place, weights=o).astype(np.int64)[place] for o in own]
        at, out = 0, []
        for b, c, k in zip(g["bucket"], g["chunk"], keys):
            here = slice(at, at + len(k))
            at = here.stop
            other = np.nonzero((total[0][here] != own[0][here]) | (total[1][here] != own[1][here]))[0]
            if len(other):
                out.append((b, c, _packed(np.diff(other, prepend=0)), _packed(total[0][here][other]), _packed(total[1][here][other])))
        return pd.DataFrame(out, columns=["bucket", "chunk", "body", "n", "n_target"])

    def score(g: pd.DataFrame) -> pd.DataFrame:
        text = g[g["n"].isna()]["body"].iloc[0]
        part = pa.ipc.open_stream(text).read_next_batch()
        c = Chunk([t or "" for t in part.column(1).to_pylist()], part.column(2).to_numpy(zero_copy_only=False).astype(bool), buckets)
        totals = c.counts
        for b, body, own, own_target in zip(g["bucket"], g["body"], g["n"], g["n_target"]):
            if own is not None:
                at = c.order[c.edges[b] + np.cumsum(_unpacked(body))]
                totals[0, at], totals[1, at] = _unpacked(own), _unpacked(own_target)
        on_target, on_background = c.scores(totals, n, n_target)
        return pd.DataFrame({"doc_id": part.column(0).to_pandas(integer_object_nulls=True), "tokens": c.tokens, "target_loss": on_target, "background_loss": on_background, "score": on_target - on_background})

    totals = x.mapInArrow(count, schema).groupBy("bucket").applyInPandas(add, schema)
    return totals.unionByName(x.mapInArrow(keep, schema)).groupBy("chunk").applyInPandas(score, f"doc_id {kind}, tokens long, target_loss double, background_loss double, score double")

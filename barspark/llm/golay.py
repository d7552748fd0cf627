"""Near-duplicates by SimHash, candidates by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Each segment, read as a word of the perfect [23, 12]
Golay code, decodes to the index (12 bits) of the one codeword within three bits; the bits around it decode to at most six
indices. Two fingerprints that differ in at most two bits have a word between them that is at most one bit
from either. By the pigeonhole principle that one bit lies in one segment only, so the other segments keep their index,
and the key lists {(i1, i2, i3)} made by letting one segment at a time take its neighbouring indices meet in one key:
1 + 5 + 5 + 5 keys of 36 bits at most.

Keys that one fingerprint alone has are dropped by a join with the counts. What is left is verified exactly, without
forming pairs: a key is expanded into the words one bit away that decode to it (about five), and fingerprints that
share such a word are within two bits of each other. At most 65 fingerprints share a word, so no group is large; each is
linked to the smallest of its group, and the differing bits are counted once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import components, keep_rows, pick, row_key, stage, text_slices

SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, number of bits
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the Golay code's polynomial
SEED = 42
CHUNK = 1 << 15  # shingles of one document turned into bits at a time


# ---------------------------------------------------------------- fingerprints


def simhash(text: str, shingle: int = 3) -> int:
    """Fingerprint of one text as an unsigned integer: bit set where over half of the shingles' XXH64 have it set."""
    words = text.encode("utf-8").lower().split()  # bytes: lowers A-Z only and splits at 0x20 and 0x09-0x0D only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:].tolist() if len(words) >= shingle else [len(flat)]
    counts, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        hashes = np.array([h(flat[s:e], SEED) for s, e in zip(starts[at:min(n, at + CHUNK)].tolist(), last[at:at + CHUNK])], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row, fp the fingerprint's 64 bits as a signed long. Null text: as empty, fp 0."""
    x = pick(docs, doc_id=doc_id, text=text)
    kind = x.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            fp = np.array([simhash(t, shingle) for t in texts], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    return x.mapInArrow(run, f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- the code


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """index (2^23): 12-bit message of the nearest codeword; near (2^23 rows are not kept): see ``keys``."""
    messages = np.arange(1 << 12, dtype=np.int64)
    words = np.zeros_like(messages)
    for bit in range(12):  # code words are the multiples of the generator polynomial over GF(2)
        words ^= np.where(messages >> bit & 1, GENERATOR << bit, 0)
    index = np.zeros(1 << 23, np.int16)
    single = 1 << np.arange(23)
    patterns = [np.array([0])]
    a, b = np.triu_indices(23, 1)
    patterns += [single, single[a] | single[b]]
    three = [single[i] | single[j] | single[k] for i in range(23) for j in range(i) for k in range(j)]
    patterns.append(np.array(three))
    for p in np.concatenate(patterns):
        index[words ^ p] = messages
    return index, words


_INDEX: list[np.ndarray] = []


def _index() -> np.ndarray:
    if not _INDEX:
        _INDEX.append(golay_tables()[0])
    return _INDEX[0]


def _expanded(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words at most one bit from each fingerprint (n x 65) and their 36-bit keys of three codeword indices."""
    index, fp = _index(), fp.astype(np.uint64)
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
    words = fp[:, None] ^ flips[None, :]
    keys = np.zeros(words.shape, np.int64)
    for first, bits in SEGMENTS:
        part = (words >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        keys = (keys << 12) | index[part.astype(np.int64)].astype(np.int64)
    return words, keys


def keys_of(fp: np.ndarray) -> list[np.ndarray]:
    """Distinct keys of each fingerprint, at most 16."""
    return [np.unique(k) for k in _expanded(fp)[1]]


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column ``fp`` that connect what is within two bits.

    Every pair within two bits is joined by a path of such links (each link itself within two bits), so the
    components are those of all pairs.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                lists = keys_of(fp.view(np.uint64) if fp.dtype == np.int64 else fp)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, [len(k) for k in lists])), pa.array(np.concatenate(lists))], ["fp", "key"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp = part.column(0).to_numpy(zero_copy_only=False)
                words, keys = _expanded(fp.view(np.uint64))
                row, col = np.nonzero(keys == part.column(1).to_numpy(zero_copy_only=False)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(words[row, col].view(np.int64))], ["fp", "word"])

    candidates = fps.select("fp").mapInArrow(emit, "fp long, key long")
    shared = candidates.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    met = candidates.join(shared, "key").select("fp", "key").mapInArrow(expand, "fp long, word long")
    groups = met.groupBy("word").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 members at most
    pairs = groups.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per input row: documents whose fingerprints are linked at two or fewer bits.

    ``component_id`` is the smallest id reachable over any chain of links. Exact copies meet in one fingerprint and are
    counted once, so a group of copies costs one row after a map-side minimum. Null and empty texts have fingerprint
    zero and are linked like any other; rows that repeat an id get the same component; an id that is null keeps
    its row and never becomes a component's id unless it has no other. Empty tables give no rows.
    """
    fp = stage(fingerprints(docs, doc_id, text))
    nodes = stage(fp.groupBy("fp").agg(F.min("doc_id").alias("low")))
    parts = components(links(nodes))
    rooted = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stage(rooted.join(low, "root").select("fp", "component_id"))
    return fp.join(named, "fp").select("doc_id", "fp", "component_id")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of exactly one row per component of ``near_duplicates``: the smallest id's, null ids last.

    Chosen among rows, not ids: ids may be null or repeated, also with different texts.
    """
    keyed = docs.withColumn("_row", row_key(docs, doc_id))
    nodes = stage(fingerprints(keyed, "_row", text).groupBy("fp").agg(F.min("doc_id").alias("low")))
    root = components(links(nodes)).withColumnRenamed("node", "fp")
    low = nodes.join(root, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("low").alias("low"))
    return keep_rows(keyed, low)

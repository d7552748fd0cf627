"""Near copies by the Jaccard similarity of their word shingles, verified exactly.

A text is the set of the XXH64 of its five-word shingles (words as for ``golay.simhash``). Texts with equal sets are one node. Candidates
are nodes that share a key. Keys are the Golay keys of the SimHash over the same shingles (``golay.keys_of``), which find what differs in a
bit or two, and ``BANDS`` bands of ``ROWS`` MinHash values each for the rest: two texts of similarity 0.8 miss all bands with a probability of
(1 - 0.8^4)^32 = 5e-8, more similar ones less often.

No pairs are formed within what already hangs together: first every member of a bucket is compared with one of them, the one with the most
company in all its buckets (of copies with many and with few edits it is one with few, to which most are alike), and components are built from the pairs that hold.
Only nodes of buckets that still span several components are looked at again, by prefixes: with the shingles of these nodes ordered by the number
of nodes that hold them, the first common shingle of two sets leaves both at least as many shingles from there on as they must share. What a text holds alone comes first,
so texts that differ too much share nothing early enough. This loses no pair of the similarity, whatever the buckets are. In each shingle's
group the members outside its largest component meet those of like size. So each candidate pair is either verified or inside one component.

A pair of the first comparison is looked at twice. Every node has a parity sketch, one bit per cell telling whether an odd number of its shingles fall there: two sets differ
in at least as many shingles as their sketches differ in bits, so a pair whose sketches differ too much is out, with certainty, and
costs a few hundred bytes. Only what passes is compared by the sets themselves, which are made for those nodes alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm import golay
from barspark.llm.common import components, keep_rows, pick, row_key, stage, text_slices

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
SEED = 42
CHUNK = 1 << 9  # shingles hashed by all MinHash functions at a time
LEAST_CELLS = 256
CLASS = 1.05  # ratio of the sizes from one size class to the next
SLICE = 2 << 20  # text worked on at a time
_MIX = np.random.default_rng(SEED).integers(0, 2**63, (BANDS * ROWS, 2)).astype(np.uint64)


# ---------------------------------------------------------------- one text


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the shingles in order, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1:].tolist() if len(words) >= shingle else [len(flat)]
    h = xxhash.xxh64_intdigest
    return np.array([h(flat[s:e], SEED) for s, e in zip(starts.tolist(), last)], np.uint64)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, shingle))


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each set where over half of the hashes have it set; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), golay.CHUNK):
        counts += np.unpackbits(hashes[at:at + golay.CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def band_keys(shingles: np.ndarray) -> list[int]:
    """One 64-bit key per band, from the minima of ``ROWS`` multiply-xor hashes each. No shingles: no keys."""
    if not len(shingles):
        return []
    low = np.full(len(_MIX), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        x = (shingles[None, at:at + CHUNK] ^ _MIX[:, 1:]) * (_MIX[:, :1] | np.uint64(1))
        x ^= x >> np.uint64(32)
        np.minimum(low, x.min(axis=1), out=low)
    return [xxhash.xxh64_intdigest(low[i * ROWS:(i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]


def sketch(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of 2n cells or more, a power of two."""
    cells = max(LEAST_CELLS, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else LEAST_CELLS
    return np.packbits(np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Shingles that are in one of the sets only are at least as many: bits by which the sketches differ, the larger one folded."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def most_difference(na: int, nb: int, similarity: float) -> float:
    """Shingles in one set only that a similarity allows: with d of them it is (na + nb - d) / (na + nb + d)."""
    return (na + nb) * (1 - similarity) / (1 + similarity) + 1e-6


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


# ---------------------------------------------------------------- tables


def nodes_of(docs: DataFrame, row: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(row, node, size, keys, sketch) per input row: node names the shingle set, size its length."""
    x = pick(docs, row=row, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, slice_bytes=SLICE):
            lists = [shingle_hashes(t, shingle) for t in texts]
            close = golay.keys_of(np.array([simhash(h) for h in lists], np.uint64))
            sets = [np.unique(h) for h in lists]
            keys = [np.concatenate((np.array(band_keys(s), np.uint64).astype(np.int64), k)) if len(s) else np.zeros(0, np.int64) for s, k in zip(sets, close)]
            cols = [part.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "node", "size", "keys", "sketch"])

    return x.mapInArrow(run, f"row {x.schema['row'].dataType.simpleString()}, node binary, size long, keys array<long>, sketch binary")


def _pruned(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs (a, na, sa, b, nb, sb) whose sketches allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(i).to_pylist() for i in (1, 4))
            good = [least_difference(sa, sb) <= most_difference(n, m, similarity) for n, sa, m, sb in zip(na, b.column(2).to_pylist(), nb, b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "na", "sa", "b", "nb", "sb").mapInArrow(run, "a binary, b binary")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, slice_bytes=SLICE):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, shingle).astype("<u8").tobytes() for t in texts], pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node binary, shingles binary")


def _elements(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, w) of (node, text): a row per distinct shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, slice_bytes=SLICE):
            sets = [shingle_set(t, shingle) for t in texts]
            at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(np.concatenate(sets).view(np.int64))], ["node", "w"])

    return texts.mapInArrow(run, "node binary, w long")


def _verified(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (b.column(i) for i in (2, 3))
            good = [jaccard(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")) >= similarity for x, y in zip(one, two)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    sets = stage(_sets(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), shingle))
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a")
    x = x.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b").select("a", "b", "one", "two")
    return stage(x.mapInArrow(run, "a binary, b binary"))


def _alike(similarity: float):
    """Sizes that allow the similarity at all."""
    return F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-6


def _side(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("node").alias(name), F.col("sketch").alias(f"s{name}"))


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size) / math.log(CLASS)).cast("int")


def _prefix_pairs(open_: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of nodes with different roots, among them all that have the similarity.

    ``open_`` is (node, size, root), ``elements`` its (node, w). ``rest`` is the number of a node's shingles from this one on, in the order of how many
    nodes hold them. Two sets share at most the smaller rest at their first common shingle, and must share s / (1 + s) of both sizes: so
    a shingle speaks only for partners up to a certain size, and for none once its rest is below s times its own.
    """
    many = elements.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    upward = Window.partitionBy("node").orderBy(F.desc("df"), F.desc("w"))
    early = elements.join(many, "w").withColumn("rest", F.row_number().over(upward)).join(open_, "node").where(F.col("rest") >= F.lit(similarity) * F.col("size") - 1e-6)
    early = stage(early.select("w", "node", "size", "root", "rest"))
    parts = early.groupBy("w", "root").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("w").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "root")).alias("big")).where("parts > 1")
    met = stage(early.join(parts.select("w", F.col("big.root").alias("big")), "w"))
    least, most = similarity * F.col("size") - 1e-6, F.col("rest") * ((1 + similarity) / similarity) - F.col("size") + 1e-6
    classes = F.sequence(_size_class(F.greatest(least, F.lit(1))), _size_class(F.greatest(least, most, F.lit(1))))
    one = met.where("root <> big").select("w", F.explode(classes).alias("class"), F.col("node").alias("a"), F.col("size").alias("na"), F.col("root").alias("ra"), F.col("rest").alias("la"))
    two = met.select("w", _size_class(F.col("size")).alias("class"), F.col("node").alias("b"), F.col("size").alias("nb"), F.col("root").alias("rb"), F.col("rest").alias("lb"))
    enough = F.least("la", "lb") >= F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-6
    x = one.join(two, ["w", "class"]).where(F.col("ra") != F.col("rb")).where(_alike(similarity)).where(enough)
    return x.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def groups(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): the components of all candidate pairs with the similarity; nodes without a link are left out.

    ``nodes`` is a staged (node, size, keys, sketch), a row per node; ``texts_of`` gives (node, text) for a table of nodes.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    every = nodes.select("node", "size", F.explode("keys").alias("key"))
    met = stage(every.join(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"))
    company = met.groupBy("node").agg(F.sum("n").alias("company"))
    lead = met.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node", "size")).alias("lead"))
    pairs = met.join(lead, "key").select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("lead.node").alias("b"), F.col("lead.size").alias("nb")).where("a <> b").where(_alike(similarity)).distinct()
    near = stage(_pruned(pairs.join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b"), similarity))
    first = _verified(near, texts_of, shingle, similarity)
    root = stage(components(first).select("node", "root"))
    met = met.join(root, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    split = met.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_ = stage(met.join(split, "key").select("node", "size", "root").distinct())
    # what the second comparison found joins components of the first: only these are gone through again
    second = _verified(stage(_prefix_pairs(open_, stage(_elements(texts_of(open_.select("node")), shingle)), similarity)), texts_of, shingle, similarity)
    ends = second.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    ends = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = stage(components(ends).select(F.col("node").alias("root"), F.col("root").alias("top")))
    alone = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(root.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return root.unionByName(alone).join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """All columns of exactly one row per group of texts linked at ``similarity`` or more: the smallest id's, null ids last.

    Ids may be null or repeated: groups are of rows. Null texts and texts without words are one group. A task holds ``SLICE`` of text, or one
    longer text, at a time.
    """
    keyed = docs.withColumn("_row", row_key(docs, doc_id))
    got = nodes_of(keyed, "_row", text, shingle)
    nodes = stage(got.groupBy("node").agg(F.min("row").alias("low"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))

    def texts_of(wanted: DataFrame) -> DataFrame:
        rows = nodes.join(wanted, "node").select("node", F.col("low.h1").alias("_h1"), F.col("low.h2").alias("_h2"))
        one = keyed.select(F.col("_row.h1").alias("_h1"), F.col("_row.h2").alias("_h2"), F.col(f"`{text}`").alias("text")).join(rows, ["_h1", "_h2"])
        return one.select("node", "text").dropDuplicates(["node"])

    root = groups(nodes, texts_of, shingle, similarity)
    low = nodes.join(root, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("low").alias("low"))
    return keep_rows(keyed, low)

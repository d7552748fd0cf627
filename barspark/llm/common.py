"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.operators.series import shared_folder, stage

__all__ = ["shared_folder", "stage", "small_batches", "pick", "train_part", "row_key", "keep_rows", "components", "text_slices", "input_bytes"]

SLICE_BYTES = 4 << 20  # texts are worked on in slices of about this size, whatever the Arrow batch holds


BATCH_ROWS = 2_000  # rows of texts that Spark hands to a Python worker at a time


def small_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_ROWS`` rows between Spark and its workers: both hold one of them, and a row is a whole text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under new names: other columns, whatever they are called, take no part."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in cols.items()])


def train_part(doc_id: Column) -> Column:
    """True where labels may be learned from: crc32 of the id as text, modulo 3, is not 1 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def row_key(docs: DataFrame, doc_id: str) -> Column:
    """A row's own key, ordered by its id with nulls last, then by 128 bits over all its columns: only equal rows share one."""
    cols = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    cols += [F.col(f"`{c}`").isNull() for c in docs.columns]  # the hash skips nulls
    one = F.col(f"`{doc_id}`")
    return F.struct(one.isNull().alias("none"), one.alias("id"), F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(1), *cols).alias("h2"))


def keep_rows(keyed: DataFrame, low: DataFrame) -> DataFrame:
    """Of documents with their ``row_key`` as ``_row`` those whose key is in column ``low``, each once; without the key."""
    x = keyed.withColumns({"_h1": F.col("_row.h1"), "_h2": F.col("_row.h2")})
    got = x.join(low.select(F.col("low.h1").alias("_h1"), F.col("low.h2").alias("_h2")), ["_h1", "_h2"], "left_semi").dropDuplicates(["_h1", "_h2"])  # one shuffle for both
    return got.select(*[F.col(f"`{c}`") for c in keyed.columns if c != "_row"])


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut record batches into slices of about ``slice_bytes`` of text (one row at least); null texts become empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        at = 0
        while at < batch.num_rows:
            part, size = [], 0
            while at + len(part) < batch.num_rows and (not part or size < slice_bytes):
                t = texts[at + len(part)].as_py() or ""
                part.append(t)
                size += len(t)
            yield batch.slice(at, len(part)), part
            at += len(part)


def input_bytes(df: DataFrame, column: str) -> int:
    """Exact bytes in a text column, one narrow aggregation."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: one row (node, root) per node, root the smallest node reachable.

    Alternating large-star and small-star steps (each a group-by on one endpoint with a map-side minimum and a join),
    staged after each round, until the edge set no longer changes. A node with many neighbours is a group
    only for ``min``, never for a list, and every step hangs a node directly under a smaller one, so
    the number of rounds grows with the logarithm of the longest chain. Self-loops and null ends are dropped;
    an empty edge table gives an empty result.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = stage(e)
    mark = _fingerprint(e)
    while mark[0]:
        # large star: strictly larger neighbours of each node move under the smallest node of its neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours of each node, and the node itself, move under the smallest of them
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        e = stage(down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
                  .select("e.a", "e.b").where("a <> b").distinct())
        now = _fingerprint(e)
        if now == mark:
            break
        mark = now
    leaves = e.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root")).groupBy("node").agg(F.min("root").alias("root"))


def _fingerprint(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(r)

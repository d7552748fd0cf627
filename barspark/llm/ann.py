"""Approximate nearest neighbours by learned partitions.

1. On a bounded sample a graph of nearest neighbours is built and cut into parts of equal size by recursive spectral bisection:
   each cut splits a part at the median of the graph's second eigenvector, so neighbours mostly stay together.
2. A small softmax classifier learns the part of a vector from the vector, with the parts of its neighbours as soft targets.
3. Every vector is stored in its most probable part. A query goes to its several most probable parts - as many as the sample
   needs for the wanted recall - and all vectors there are ranked by their exact inner product.

Parts are cut into blocks of bounded size, and so are the queries that meet in one, so a part that holds a third of all vectors is
spread over many tasks. Scores are sums of products of doubles in a fixed order, so equal vectors have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import pick, stage

SAMPLE = 8_192  # vectors the partitions are learned from
PARTS = 32
NEIGHBOURS = 10
RECALL = 0.97  # wanted on the sample
BLOCK = 8_192  # stored vectors, or
QUERIES = 2_048  # queries, in one group
SEED = 5


# ---------------------------------------------------------------- fitting, on the sample


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Numbers of the ``k`` vectors with the largest inner product with each, itself left out."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at:at + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, :out.shape[1]]
    return out


def bisect(graph: np.ndarray, parts: int, rounds: int = 60) -> np.ndarray:
    """Part of each node: parts (a power of two) of sizes that differ by one at most per cut."""
    n, rng = len(graph), np.random.default_rng(SEED)
    a = np.repeat(np.arange(n), graph.shape[1])
    b = graph.ravel()
    part = np.zeros(n, np.int64)
    for _ in range(max(0, parts.bit_length() - 1)):
        inner = part[a] == part[b]
        i, j = np.concatenate((a[inner], b[inner])), np.concatenate((b[inner], a[inner]))
        degree = np.maximum(np.bincount(i, minlength=n), 1)
        size = np.bincount(part)
        v = rng.standard_normal(n)
        for _ in range(rounds):  # power iteration of the lazy walk, away from each part's constant vector
            v = 0.5 * (v + np.bincount(i, weights=v[j], minlength=n) / degree)
            v -= (np.bincount(part, weights=v * degree) / np.bincount(part, weights=degree))[part]
            v /= np.sqrt(np.bincount(part, weights=v * v) + 1e-300)[part]
        order = np.lexsort((v, part))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.concatenate(([0], np.cumsum(size)))[part[order]]
        part = part * 2 + (rank >= (size // 2)[part])
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Router:
    """Softmax classifier over parts, and the number of parts a query is sent to."""

    weights: np.ndarray  # dimensions + 1 by parts
    probes: int

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector from the most probable; ties to the smaller number."""
        return np.argsort(-_scores(self.weights, x), axis=1, kind="stable")


def _scores(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return x @ weights[:-1] + weights[-1]


def learn(x: np.ndarray, parts: int = PARTS, k: int = 20, recall: float = RECALL) -> Router:
    """Router from the sample's vectors. A sample too small to be cut gives one part."""
    while parts > 1 and len(x) < 8 * parts:
        parts //= 2
    if parts == 1:
        return Router(np.zeros((x.shape[1] + 1 if x.ndim == 2 else 1, 1)), 1)
    graph = neighbour_graph(x)
    part = bisect(graph, parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.arange(len(x)), part), graph.shape[1])
    for col in graph.T:
        np.add.at(soft, (np.arange(len(x)), part[col]), 1.0)
    soft /= soft.sum(axis=1, keepdims=True)
    unit = np.hstack((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), np.ones((len(x), 1))))
    w, m, s = np.zeros((unit.shape[1], parts)), 0.0, 0.0
    for step in range(1, 301):  # Adam on the whole sample
        g = unit.T @ (softmax(unit @ w) - soft) / len(x)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    order = Router(w, 1).ranked(x)
    home = order[:, 0]
    some = np.random.default_rng(SEED).permutation(len(x))[:512]
    near = neighbour_graph(x, min(k, len(x) - 1))[some]
    place = np.empty((len(some), parts), np.int64)
    np.put_along_axis(place, order[some], np.arange(parts)[None, :].repeat(len(some), 0), axis=1)
    at = np.take_along_axis(place, home[near], axis=1)
    found = [(at < p).mean() for p in range(1, parts + 1)]
    return Router(w, next(p for p, r in enumerate(found, 1) if r >= recall or p == parts))


# ---------------------------------------------------------------- search


def exact_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query ids and scores of its ``k`` best rows, itself left out, ties to the smaller id.

    A matrix product finds who may be among them; their scores are then summed row by row, the same way for every row.
    """
    for at in range(0, len(q), 256):
        rough = q[at:at + 256] @ x.T
        rough[query_ids[at:at + 256, None] == ids[None, :]] = -np.inf
        for i, row in enumerate(rough):
            n = int((row > -np.inf).sum())
            if not n:
                yield ids[:0], row[:0]
                continue
            low = np.partition(row, len(row) - min(k, n))[len(row) - min(k, n)]
            may = np.nonzero(row >= low - 1e-9 * (1 + abs(low)))[0]
            score = (x[may] * q[at + i]).sum(axis=1)
            best = np.lexsort((ids[may], -score))[:k]
            yield ids[may][best], score[best]


def usable(v: str) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.col(v).isNotNull() & F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, parts: int = PARTS, recall: float = RECALL, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of the rows for which ``is_query`` holds, among all other rows.

    Unusable vectors, null ids and vectors of another length than most take no part. Rows that repeat an id are that
    id's vector once (the smallest). Fewer candidates give fewer ranks; an empty table gives none.
    """
    x = vectors.where(is_query).select(F.col(f"`{vec_id}`").alias("vec_id")).distinct().withColumn("is_query", F.lit(True))
    v = pick(vectors, vec_id=vec_id, v=embedding).withColumn("v", F.col("v").cast("array<double>")).where(F.col("vec_id").isNotNull() & usable("v"))
    v = stage(v.groupBy("vec_id").agg(F.min("v").alias("v")).join(x, "vec_id", "left").select("vec_id", "v", F.coalesce("is_query", F.lit(False)).alias("is_query")))
    size = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return vectors.sparkSession.createDataFrame([], schema)
    v = v.where(F.size("v") == size["d"])
    fitted = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()  # bounded
    router = learn(np.array(fitted["v"].tolist(), np.float64), parts, k, recall)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order = router.ranked(np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(order[:, :router.probes].astype(np.int32).tolist(), pa.list_(pa.int32()))], ["vec_id", "v", "is_query", "parts"])

    routed = stage(v.mapInArrow(route, "vec_id long, v array<double>, is_query boolean, parts array<int>"))
    stored = routed.select("vec_id", "v", F.col("parts")[0].alias("part"))
    asked = routed.where("is_query").select("vec_id", "v", F.explode("parts").alias("part"))

    def blocks(df: DataFrame, most: int, name: str) -> DataFrame:
        return df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))  # one row per part

    cut = {r["part"]: (r["stored"], r["asked"]) for r in blocks(stored, block, "stored").join(blocks(asked, queries, "asked"), "part").collect()}
    if not cut:
        return vectors.sparkSession.createDataFrame([], schema)
    n = F.create_map(*[F.lit(i) for p, c in cut.items() for i in (p, c[0])])
    m = F.create_map(*[F.lit(i) for p, c in cut.items() for i in (p, c[1])])

    def spread(df: DataFrame, own: Column, other: Column, names: tuple[str, str]) -> DataFrame:
        df = df.where(F.col("part").isin(list(cut)))
        df = df.withColumn(names[0], F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.try_element_at(own, F.col("part"))).cast("int"))
        return df.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.try_element_at(other, F.col("part")) - 1)))

    left = spread(asked, m, n, ("qb", "sb"))
    right = spread(stored, n, m, ("sb", "qb"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            qid = a["vec_id"].to_numpy()
            tops = exact_top(b["vec_id"].to_numpy(), np.stack(b["v"].to_numpy()), qid, np.stack(a["v"].to_numpy()), k)
            out = [pd.DataFrame({"query_id": q, "vec_id": i, "score": s}) for q, (i, s) in zip(qid, tops)]
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    groups = ("part", "sb", "qb")
    tasks = max(1, min(2_000, sum(a * b for a, b in cut.values())))
    near = left.repartition(tasks, *groups).groupBy(*groups).cogroup(right.repartition(tasks, *groups).groupBy(*groups)).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most probes x blocks x k rows each
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

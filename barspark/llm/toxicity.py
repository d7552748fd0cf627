"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

1. A lexicon is learned from labelled rows: words and word beginnings that mark toxic texts far more often than chance
   would (log-likelihood ratio), so it follows the language of the data. A short base list is always in it.
2. Every text becomes a dozen numbers: lexicon densities and weights, closeness of second-person words to lexicon words,
   capitals, punctuation, rates of obfuscated words and of obfuscated lexicon words.
3. MLlib's boosted trees are fitted on one part of the labelled rows and calibrated by isotonic regression on the other.

Labelled rows used for fitting are bounded by ``TRAIN_ROWS`` (distinct texts, taken by a hash of the id), and the lexicon by
``LEXICON`` entries; everything else covers all rows and whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from barspark.llm.common import pick, stage, text_slices

TRAIN_ROWS = 30_000
LEXICON = 4_096
LEAST_TEXTS, LEAST_RATIO = 3, 10.0  # toxic texts with an entry; log-likelihood ratio of an entry
BEGINNINGS = (3, 5, 7)
CACHE_WORDS = 200_000  # words whose weights a worker remembers
BASE_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
BASE_WEIGHT = 2.0
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
UNMASK = str.maketrans("013457@$!|€", "oieastasiie")
NAMES = ("density", "hits", "weight_mean", "weight_max", "beginning_density", "second_person_near", "second_person", "capitals", "capital_words",
         "punctuation", "exclamations", "obfuscated", "obfuscated_hits", "words")
WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_]+(?:[\d@$!|€*]+[^\W\d_]+)+")
SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-*_]){3,}[^\W\d_](?![^\W\d_])")


def units(words: set[str]) -> set[str]:
    """Words, and beginnings of words written with a closing hyphen."""
    out = set(words)
    for w in words:
        out.update(w[:k] + "-" for k in BEGINNINGS if len(w) > k)
    return out


def unmasked(text: str, masked: bool = True, apart: bool = True) -> list[str]:
    """Words with digits or signs for letters put back, and letters written apart joined."""
    out = [m.lower().translate(UNMASK).replace("*", "") for m in MASKED.findall(text)] if masked else []
    return out + ([re.sub(r"[ .\-*_]", "", m).lower() for m in SPACED.findall(text)] if apart else [])


def _kinds(text: str) -> np.ndarray:
    """Per character: 1 capital, 2 white space, 4 digit or sign that may stand for a letter."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _KIND[raw]
    if (kind == 255).any():
        for c in np.unique(raw[kind == 255]).tolist():
            ch = chr(c)
            _KIND[c] = ch.isupper() + 2 * ch.isspace() + 4 * (ch.isdigit() or ch in "@$!|€*")
        kind = _KIND[raw]
    return kind


_KIND = np.full(0x110000, 255, np.uint8)


class Weights(dict):
    """Word to (weight as a word, weight of its beginnings), (0, 0) for second-person words, None for all others; made when asked for."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, w: str) -> tuple[float, float] | None:
        if len(self) > CACHE_WORDS:
            self.clear()
        get = self.lexicon.get
        whole, start = get(w, 0.0), max([get(w[:k] + "-", 0.0) for k in BEGINNINGS if len(w) > k], default=0.0)
        self[w] = v = (whole, start) if whole or start else (0.0, 0.0) if w in SECOND_PERSON else None
        return v


def features(text: str, weights: Weights) -> list[float]:
    """NAMES of one text."""
    lexicon = weights.lexicon
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    hits = begun = 0
    total = top = near = 0.0
    last_you = last_hit = -10**9
    you = 0
    for i, v in [(i, v) for i, v in enumerate(map(weights.__getitem__, words)) if v]:
        whole, start = v
        if whole or start:
            hits += whole > 0
            begun += start > 0
            total += max(whole, start)
            top = max(top, whole, start)
            last_hit = i
        else:
            you += 1
            last_you = i
        near = max(near, 1.0 / (1 + abs(last_you - last_hit)))
    kind = np.bincount(_kinds(text), minlength=8)
    letters = sum(map(len, words)) or 1
    capitals = int(kind[1])
    shouted = sum(1 for w in WORD.findall(text) if len(w) > 2 and w.isupper()) if capitals > 2 * letters / 10 else 0
    size = len(text) or 1
    signs = size - letters - int(kind[2])
    single = [i for i, w in enumerate(words) if len(w) == 1]
    apart = any(b - a == 3 for a, b in zip(single, single[3:]))
    hidden = unmasked(text, bool(kind[4]), apart) if kind[4] or apart else []
    found = sum(1 for w in hidden if lexicon.get(w, 0.0) > 0)
    return [hits / n, math.log1p(hits), total / n, top, begun / n, near, you / n, capitals / letters, shouted / n, max(0, signs) / size, text.count("!") / n, len(hidden) / n, math.log1p(found), math.log1p(len(words))]


@dataclass(frozen=True)
class Model:
    """Fitted parts. Without trees (no labelled rows, or one class only) every score is ``rate``."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column | None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, h, y): at most ``rows`` labelled documents with distinct texts (h hashes the text), y 1 if any of the labels of its id is 1.

    Of an id with several texts the one with the smallest hash is taken.
    """
    y = pick(labels, doc_id=doc_id, y=label).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max(F.when(F.col("y") == 1, 1.0).otherwise(0.0)).alias("y"))
    x = docs.where(F.lit(True) if usable is None else usable)
    ids = pick(x, doc_id=doc_id, text=text).select("doc_id", _text_hash().alias("h"))
    one = ids.join(y, "doc_id").groupBy("h").agg(F.min_by(F.struct("doc_id", "y"), "doc_id").alias("r")).select("h", "r.doc_id", "r.y")
    one = one.groupBy("doc_id").agg(F.min(F.struct("h", "y")).alias("r")).select("doc_id", "r.h", "r.y")
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _texts_of(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, y) of the chosen rows, each once; ``rows`` is bounded, so it is broadcast."""
    x = pick(docs, doc_id=doc_id, text=text).withColumn("h", _text_hash()).join(F.broadcast(rows), ["doc_id", "h"])
    return x.dropDuplicates(["doc_id"]).select("doc_id", "text", "y")


def learn_lexicon(docs: DataFrame, rows: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = LEXICON) -> dict[str, float]:
    """Weights (log-odds) of the ``size`` entries that mark toxic texts most clearly; ``rows`` is bounded, so it is broadcast."""
    x = _texts_of(docs, rows, doc_id, text).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            bad, good = Counter(), Counter()
            for t, y in zip(texts, part.column(0).to_pylist()):
                (bad if y else good).update(units(set(WORD.findall(t.lower()))))
            names = list(bad.keys() | good.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[w] for w in names], pa.int64()), pa.array([good[w] for w in names], pa.int64())], ["unit", "bad", "good"])

    totals = rows.agg(F.sum("y"), F.count(F.lit(1))).first()
    n_bad = float(totals[0] or 0)
    n_good = float(totals[1]) - n_bad
    if not n_bad or not n_good:
        return {w: BASE_WEIGHT for w in BASE_WORDS}
    c = x.mapInArrow(run, "unit string, bad long, good long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= LEAST_TEXTS)
    n = F.col("bad") + F.col("good")
    share, other, base = F.col("bad") / n, F.col("good") / n, n_bad / (n_bad + n_good)
    ratio = F.col("bad") * F.log(share / base) + F.when(F.col("good") > 0, F.col("good") * F.log(other / (1 - base))).otherwise(0.0)
    odds = F.log((F.col("bad") + 0.5) / (n_bad - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (n_good - F.col("good") + 0.5))
    top = c.select("unit", ratio.alias("ratio"), odds.alias("odds")).where((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") > 1)).orderBy(F.desc("ratio"), "unit").limit(size).collect()
    return {w: BASE_WEIGHT for w in BASE_WORDS} | {r["unit"]: r["odds"] for r in top}


def with_features(docs: DataFrame, lexicon: dict[str, float], keep: dict[str, str], text: str = "text", to: str = "_dense") -> DataFrame:
    """The columns ``keep`` (new name: column) and the dense features as an array, one row per input row."""
    x = pick(docs, **keep, **{f"{to}_text": text})
    schema = x.drop(f"{to}_text").schema.add(to, ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(lexicon)
        for part, texts in text_slices(batches, f"{to}_text"):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([features(t, weights) for t in texts], pa.list_(pa.float64()))], [*keep, to])

    return x.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Learn lexicon, trees and calibration from the labelled rows for which ``usable`` (a condition on ``docs``) is true."""
    chosen = stage(training_rows(docs, labels, usable, doc_id, text, label, rows))
    lexicon = learn_lexicon(docs, chosen, doc_id, text)
    train = with_features(_texts_of(docs, chosen, doc_id, text), lexicon, {"doc_id": "doc_id", "y": "y"})
    train = stage(train.withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(10))))
    train = train.select("y", "part", array_to_vector("_dense").alias("x"))
    seen = {(r[0], r[1]): r[2] for r in train.groupBy((F.col("part") < 7).alias("fit"), "y").agg(F.count(F.lit(1))).collect()}
    total = sum(seen.values())
    rate = sum(n for (_, y), n in seen.items() if y) / total if total else 0.0
    if any((True, y) not in seen for y in (0.0, 1.0)):
        return Model(lexicon, None, None, rate)
    trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, subsamplingRate=1.0, seed=7).fit(train.where("part < 7"))
    calibration = None
    if all((False, y) in seen for y in (0.0, 1.0)):
        held = stage(_margin(trees, train.where("part >= 7")).select("margin", "y"))
        calibration = IsotonicRegression(featuresCol="margin", labelCol="y", predictionCol="score").fit(held)
    return Model(lexicon, trees, calibration, rate)


def _margin(trees: GBTClassificationModel, df: DataFrame) -> DataFrame:
    return trees.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1])


def score(docs: DataFrame, model: Model, keep: dict[str, str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score`` from 0 to 1, one row per input row, null and empty texts included.

    Isotonic steps are flat, so two hundredths of the score come from the trees' own probability: order is kept within a step.
    """
    inner = {f"k{i}": c for i, c in enumerate(keep.values())}
    x = with_features(docs, model.lexicon, inner, text)
    if model.trees is None:
        x = x.withColumn("score", F.lit(float(model.rate)))
    else:
        x = _margin(model.trees, x.withColumn("x", array_to_vector("_dense")))
        own = 1 / (1 + F.exp(-2 * F.col("margin")))
        if model.calibration is None:
            x = x.withColumn("score", own)
        else:
            x = model.calibration.transform(x.withColumn("own", own)).withColumn("score", 0.98 * F.col("score") + 0.02 * F.col("own"))
    return x.select(*[F.col(i).alias(n) for i, n in zip(inner, keep)], F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score"))

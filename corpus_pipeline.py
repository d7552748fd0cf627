"""A training corpus from ``documents``: language, toxicity, near-duplicates, benchmark passages, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes each stage's rows as Parquet in the shared folder
and reads them again, so a lost executor costs at most the running stage.
"""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import decontam, langid, nearcopies, packing, toxicity
from barspark.llm.common import small_batches, stage, train_part
from barspark.llm.queries import TOKENIZER
from barspark.operators.series import drop_staged, staged

TOXIC_SCORE = 0.7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose language can't be told: null, or without a letter. Short texts have low scores and stay."""
    small_batches(spark)
    profiles = langid.fit(docs, usable=train_part(F.col("doc_id")))
    inner = {f"c{i}": c for i, c in enumerate(docs.columns)}
    got = langid.predict(docs, profiles, inner)
    got = got.where(F.col("lang_pred") != langid.UNDETERMINED)
    return got.select(*[F.col(i).alias(c) for i, c in inner.items()])


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts with a toxicity score of ``TOXIC_SCORE`` or more; the model learns from the labels of the training part."""
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=train_part(F.col("doc_id")))
    inner = {f"c{i}": c for i, c in enumerate(docs.columns)}
    got = toxicity.score(docs, model, inner).where(F.col("score") < TOXIC_SCORE)
    return got.select(*[F.col(i).alias(c) for i, c in inner.items()])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, the smallest id's, of each group of texts linked by five-word shingles with a similarity of 0.8 or more (Golay keys, MinHash bands, verified)."""
    small_batches(spark)
    return nearcopies.drop_near_copies(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item within its error budget."""
    small_batches(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their sequence and offset."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("toxicity", clean_of_toxic), ("near_duplicates", one_of_each_group), ("decontamination", clean_of_benchmark), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged()
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
        drop_staged(spark, before, keep=1)  # a stage's own tables and its input, once its rows are written
    return docs

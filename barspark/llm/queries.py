"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import ann, chat, crosstok, decontam, golay, langid, lmscore, packing, pii, repair, sharding, toxicity, warc
from barspark.llm.common import shared_folder, stage, train_part
from barspark.operators.series import join_by

TOKENIZER = "word_bpe_49k.json"
LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = [f"shard-{i:03d}" for i in range(128)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_prefix_targets(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.control_conversation(spark))
    return chat.digests(chat.format_conversations(turns), chat.expand_prefixes(turns))


def op2_cross_entropy_difference(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "labels").where("quality = 1")
    return lmscore.cross_entropy_difference(table(spark, sf, "documents"), good)


def op3_golay_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    got = golay.near_duplicates(table(spark, sf, "documents"))
    return got.select("doc_id", golay.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op4_gzip_members(spark: SparkSession, sf: str) -> DataFrame:
    top = f"{shared_folder(spark)}/barspark/warc-{uuid.uuid4().hex}"
    written = stage(warc.write_monoliths(table(spark, sf, "pages"), f"{top}/whole"))
    files = written.select("file").distinct().count()
    done = stage(warc.normalise(written, warc.find_revisits(written), f"{top}/whole", f"{top}/members", files))
    got = warc.read_back(done, f"{top}/members", files)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op6_language_profiles(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    profiles = langid.fit(docs, usable=train_part(F.col("doc_id")))
    got = langid.predict(docs, profiles, {"doc_id": "doc_id"})
    return got.select("doc_id", (~train_part(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"), usable=train_part(F.col("doc_id")))
    got = toxicity.score(docs, model, {"doc_id": "doc_id"})
    return got.select("doc_id", (~train_part(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_minimum_bin_slack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER))


def op9_learned_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_lookup_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, placed, written shard by shard and read back."""
    placed = sharding.place(table(spark, sf, "documents"), F.col("doc_id"), SHARDS)
    path = f"{shared_folder(spark)}/barspark/shards-{uuid.uuid4().hex}"
    sharding.write_shards(placed, path)
    return spark.read.schema(placed.schema).parquet(path).select("doc_id", "slot", "shard")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return crosstok.alignment(table(spark, sf, "documents"), public_tokenizers.path(LEFT), public_tokenizers.path(RIGHT))


def op12_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, pii.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    found = repair.digests(repair.repair(repair.damaged(turns)))
    every = join_by(turns.select("conv_id").distinct(), found, ["conv_id"])
    figures = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


Q = {f.__name__: f for f in (op1_prefix_targets, op2_cross_entropy_difference, op3_golay_near_duplicates, op4_gzip_members, op5_decontamination, op6_language_profiles,
                             op7_toxicity, op8_minimum_bin_slack, op9_learned_partitions, op10_lookup_sharding, op11_cross_tokenizer_alignment, op12_personal_data, op13_conversation_repair)}


def _escaped(c: str) -> str:
    return rf"""regexp_replace(regexp_replace({c}, '(<)(\\*)(/?s>|</?SYS>>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g')"""


S: dict[str, str] = {
    "op1_prefix_targets": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(13 + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op4_gzip_members": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     k AS (SELECT d, n, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, p.n AS payload_bytes, p.d AS payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n = k.n""",
}

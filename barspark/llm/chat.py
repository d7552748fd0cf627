r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn is written ``<s>role[INST]text</s>``. Control strings inside roles and texts are made harmless by a backslash after their
first character (one more if some are there already), which is undone on reading, so any text comes back exactly:
``</s>`` becomes ``<\/s>`` and ``<\/s>`` becomes ``<\\/s>``.

Every assistant turn becomes an example of its own: the text holds all turns up to it, and the loss mask (code points from
``loss_start`` up to ``loss_end``) covers that reply and nothing else. The expansion's size is that of its examples; a
conversation is one value in the output, so the turns of one conversation meet in one task, and no more than that.

Order within a conversation: turn, then role, then text (nulls first), so repeated rows and ties have a fixed order. Null roles and
texts are empty; a null conv_id is a conversation; conversations without an assistant turn have no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.common import pick

OPEN, MID, CLOSE, LEARNED = "<s>", "[INST]", "</s>", "assistant"
ANGLE, SQUARE = r"(/?s>|</?SYS>>)", r"(/?INST\])"  # what follows "<" and "[" in a control string


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"(<)(\\*)" + ANGLE, r"$1\\$2$3")
    return F.regexp_replace(text, r"(\[)(\\*)" + SQUARE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"(<)\\(\\*)" + ANGLE, "$1$2$3")
    return F.regexp_replace(text, r"(\[)\\(\\*)" + SQUARE, "$1$2$3")


def rendered(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, number (from 1), learned, segment, and where segment and escaped text start and end."""
    x = pick(df, conv_id=conv_id, turn=turn, role=role, text=text)
    x = x.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    x = x.withColumn("head", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MID))).withColumn("body", escaped(F.col("text")))
    x = x.withColumn("segment", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("segment")).over(upto)
    x = x.withColumns({"number": F.row_number().over(order), "end": end})
    return x.select("conv_id", "number", (F.col("role") == LEARNED).alias("learned"), "segment", (F.col("end") - F.length("segment")).alias("start"), "end",
                    (F.col("end") - F.length("body") - len(CLOSE)).alias("body_start"), (F.col("end") - len(CLOSE)).alias("body_end"))


def format_conversations(df: DataFrame, **names: str) -> DataFrame:
    """(conv_id, formatted): every conversation as one text."""
    x = rendered(df, **names).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("number", "segment"))).alias("s"))
    return x.select("conv_id", F.concat_ws("", F.col("s.segment")).alias("formatted"))


def expand_prefixes(df: DataFrame, **names: str) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): one row per assistant turn, examples of a conversation numbered from 1."""
    x = rendered(df, **names)
    w = Window.partitionBy("conv_id").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"parts": F.collect_list("segment").over(w), "example": F.sum(F.col("learned").cast("int")).over(w)}).where("learned")
    return x.select("conv_id", "example", F.concat_ws("", "parts").alias("text"), F.col("body_start").alias("loss_start"), F.col("body_end").alias("loss_end"))


def turns_of(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing follows the last mark
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MID, 1)).alias("role"),
        unescaped(F.substr(p, F.instr(p, MID) + F.lit(len(MID)))).alias("text")))


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """What the mask covers, as it was in the conversation."""
    return unescaped(F.substr(text, (start + 1).cast("int"), (end - start).cast("int")))


def digests(conversations: DataFrame, examples: DataFrame) -> DataFrame:
    """Per conversation what was written, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    t = conversations.withColumn("turns", turns_of(F.col("formatted")))
    t = t.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.length("formatted").cast("long").alias("formatted_chars"),
                 F.sha2(F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))).cast("binary"), 256).alias("turns_sha256"))
    e = examples.select(F.col("conv_id").alias("_id"), "example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("reply"))
    e = e.groupBy("_id").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"])).alias("loss"))
    loss = F.coalesce("loss", F.lit(""))
    return t.join(e, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: a user and an assistant turn that both spell the template's control strings."""
    return spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")

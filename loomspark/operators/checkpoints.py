"""Count-tumbling groups of the message stream: checkpoints of 100 and chunks of 5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.text import contains_any
from .segmentation import ranked_lines, top_words


def tumbled(messages: DataFrame, size: int, name: str) -> DataFrame:
    return messages.withColumn(name, F.floor(F.col("global_index") / size).cast("long"))


def key_topics(messages: DataFrame, group: str, stop: Sequence[str] = lex.STOP_WORDS, n: int = 8, portable: bool = False) -> DataFrame:
    """(group, key_topics): the n most frequent words of each group."""
    top = top_words(messages, [group], "global_index", "text", stop, n, portable)
    return top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("key_topics"))


def checkpoints(messages: DataFrame, size: int = 100, facts: Sequence[str] = lex.CHECKPOINT_FACT_CUES, stop: Sequence[str] = lex.STOP_WORDS) -> DataFrame:
    """One row per `size` messages: span, distinct conversations, up to six facts, key topics, summary."""
    m = tumbled(messages, size, "checkpoint_id")
    spans = m.groupBy("checkpoint_id").agg(F.min("global_index").alias("start_msg_index"), F.max("global_index").alias("end_msg_index"), F.count("*").alias("message_count"), F.countDistinct("conversation_index").alias("conversations"))
    out = spans.join(key_topics(m, "checkpoint_id", stop), "checkpoint_id", "left").join(ranked_lines(m, "checkpoint_id", "global_index", F.col("full_text"), contains_any("text", facts), 6), "checkpoint_id", "left")
    head = F.format_string("Messages %d to %d: %d messages across %d conversations.", "start_msg_index", "end_msg_index", "message_count", "conversations")
    said = F.when(F.size("lines") > 0, F.concat(F.lit("Facts: "), F.array_join("lines", "; ")))
    named = F.when(F.size("key_topics") > 0, F.concat(F.lit("Topics: "), F.array_join("key_topics", ", ")))
    return out.withColumn("summary", F.concat_ws("\n", head, said, named)).withColumn("key_topics", F.coalesce("key_topics", F.array().cast("array<string>"))).drop("lines")


def chunks(messages: DataFrame, size: int = 5) -> DataFrame:
    """One row per `size` messages: span, messages in order and their texts joined by ' | '."""
    m = tumbled(messages, size, "chunk_id")
    listed = F.array_sort(F.collect_list(F.struct("global_index", "speaker", "text", "full_text")))
    out = m.groupBy("chunk_id").agg(F.min("global_index").alias("start_index"), F.max("global_index").alias("end_index"), listed.alias("messages"))
    return out.withColumn("text", F.array_join(F.transform("messages", lambda x: x["full_text"]), " | "))

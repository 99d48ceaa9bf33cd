"""Scans: CSV transcripts, conversation tables, JSON and Parquet artifacts, scenario files.

A message row is (global_index, conversation_index, local_index, speaker, text, full_text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import full_text
from .transcripts import column, records

MESSAGE = "global_index long, conversation_index long, local_index int, speaker string, text string, full_text string"
SPEAKERS = {"user": "User 1", "assistant": "User 2"}
LINE = r"^(User [12]):\s*(.*)"
MENTION = "global_index:bigint,conversation_index:bigint,speaker:string,text:string,full_text:string,injected:boolean,day_label:string"
TOPIC = "topic_id:int,start_msg_index:bigint,end_msg_index:bigint,message_count:int,topic_label:string,summary:string,key_entities:array<string>,day_label:string"
SCENARIO = f"scenario_id string, entity string, description string, messages array<struct<{MENTION}>>, topic_checkpoints array<struct<{TOPIC}>>"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_index, record): column 0 of every CSV record, multi-line cells and doubled quotes included; a file is read in many tasks."""
    return records(spark, path).select("conversation_index", column(F.col("text")).alias("record")).where(F.col("record").isNotNull())


def parsed(records: DataFrame, pattern: str = LINE) -> DataFrame:
    """(conversation_index, local_index, speaker, text): one row per spoken line; other lines and empty ones go."""
    lines = records.select("conversation_index", F.posexplode(F.split("record", "\n")).alias("at", "line"))
    said = lines.select("conversation_index", "at", F.regexp_extract(F.trim("line"), pattern, 1).alias("speaker"), F.trim(F.regexp_extract(F.trim("line"), pattern, 2)).alias("text")).where("speaker <> '' AND text <> ''")
    place = F.row_number().over(Window.partitionBy("conversation_index").orderBy("at")) - 1
    return said.select("conversation_index", place.cast("int").alias("local_index"), "speaker", "text")


def indexed(messages: DataFrame) -> DataFrame:
    """Message rows with a dense conversation number and a dense global index.

    Only one row per conversation goes through an ordering of all conversations: their sizes,
    range-partitioned and summed up in two steps, so that no window holds more than a range.
    """
    sizes = messages.groupBy("conversation_index").agg(F.count("*").alias("n"))
    ranged = sizes.repartitionByRange("conversation_index").withColumn("part", F.spark_partition_id())
    inner = Window.partitionBy("part").orderBy("conversation_index").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({"before": F.coalesce(F.sum("n").over(inner), F.lit(0)), "rank": F.coalesce(F.count("n").over(inner), F.lit(0))})
    parts = sizes_by_part(local)
    placed = local.join(F.broadcast(parts), "part").select("conversation_index", (F.col("rank") + F.col("ranks_before")).alias("dense"), (F.col("before") + F.col("rows_before")).alias("first"))
    out = messages.join(placed, "conversation_index")
    return out.select((F.col("first") + F.col("local_index")).cast("long").alias("global_index"), F.col("dense").cast("long").alias("conversation_index"), F.col("local_index").cast("int").alias("local_index"), "speaker", "text", full_text("speaker", "text").alias("full_text"))


def sizes_by_part(local: DataFrame) -> DataFrame:
    """Rows and conversations before each range; one row per partition, so broadcasting it is bounded."""
    totals = local.groupBy("part").agg(F.sum("n").alias("rows"), F.count("*").alias("ranks"), F.min("conversation_index").alias("least"))
    before = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("ranks").over(before), F.lit(0)).alias("ranks_before"))


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    return indexed(parsed(transcripts(spark, path)))


def speaker_of(role: Column, keep_system: bool) -> Column:
    named = F.when(role == "user", SPEAKERS["user"]).when(role == "assistant", SPEAKERS["assistant"])
    return named.when(role == "system", "System") if keep_system else named


def from_table(conversations: DataFrame, keep_system: bool = False) -> DataFrame:
    """Message rows of a (conv_id, turn, role, text) table; rows of other roles go, line feeds stay."""
    rows = conversations.withColumn("speaker", speaker_of(F.col("role"), keep_system)).where("speaker IS NOT NULL AND text IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return indexed(rows.select(F.col("conv_id").alias("conversation_index"), place.cast("int").alias("local_index"), "speaker", "text"))


def artifact(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A stored artifact (Parquet, or JSON by its ending); an absent one is empty."""
    from pyspark.errors import AnalysisException

    try:
        reader = spark.read.schema(schema)
        return reader.option("multiLine", True).json(path) if path.endswith(".json") else reader.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, topics) of a scenario file."""
    raw = spark.read.schema(SCENARIO).option("multiLine", True).json(path)
    return tuple(raw.select("scenario_id", "entity", F.explode(c).alias("x")).select("scenario_id", "entity", "x.*") for c in ("messages", "topic_checkpoints"))


def with_injected(base: DataFrame, injected: DataFrame) -> DataFrame:
    return base.unionByName(injected.select([c for c in injected.columns if c not in ("scenario_id", "entity")]), allowMissingColumns=True)


def lite(tables: dict[str, DataFrame], skip: Sequence[str] = ("messages",)) -> dict[str, DataFrame]:
    """The tables without those that lite mode leaves unread."""
    return {k: v for k, v in tables.items() if k not in skip}

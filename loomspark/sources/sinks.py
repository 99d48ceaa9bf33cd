"""Sinks: Parquet artifacts with a JSON export, training CSV, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intent import IntentModel


def save(df: DataFrame, path: str, json: bool = False) -> None:
    """Overwrite path with df; json adds a line-delimited export beside it."""
    df.write.mode("overwrite").parquet(path)
    if json:
        df.sparkSession.read.parquet(path).write.mode("overwrite").json(f"{path.rstrip('/')}.json")


def save_messages(messages: DataFrame, path: str) -> None:
    """The stored message table has no local_index."""
    save(messages.drop("local_index"), path)


def save_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_model(model: IntentModel, spark: SparkSession, path: str) -> None:
    """The whole classifier: regression, vocabularies, idf values and class names."""
    model.save(spark, path)


def load_model(spark: SparkSession, path: str) -> IntentModel:
    return IntentModel.load(spark, path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))

"""Optional extension: mood sums of conversations kept up to date from a stream of messages.

Sums are additive, so a stream only has to add the new messages' sums to the stored ones; the
vectors are read off the stored sums at any time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sentiment import Scorer, lexicon_scorer
from ..functions.text import occurrences

SUMS = ("n", "valence", "intensity", "curiosity", "size")


def sums(messages: DataFrame, key: str = "conversation_index", scorer: Scorer | None = None) -> DataFrame:
    """(key, n and the sums of the additive dimensions)."""
    c: Column = (scorer or lexicon_scorer())("text")["compound"]
    rows = messages.select(key, c.alias("c"), occurrences("text", "?").alias("ask"), F.length("text").alias("size"))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("c").alias("valence"), F.sum(F.abs("c")).alias("intensity"), F.sum("ask").alias("curiosity"), F.sum("size").alias("size"))


def running(stream: DataFrame, path: str, checkpoint: str, key: str = "conversation_index", scorer: Scorer | None = None) -> StreamingQuery:
    """A query in update mode that writes the changed sums of each batch to path/batch=<id>; a batch that is repeated replaces its own rows."""

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return sums(stream, key, scorer).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).start()


def current(stored: DataFrame, key: str = "conversation_index") -> DataFrame:
    """The latest sums of each key among the batches that running() wrote."""
    return stored.groupBy(key).agg(F.max_by(F.struct(*SUMS), "batch").alias("x")).select(key, "x.*")


def windowed(stream: DataFrame, at: str, width: str, late: str, key: str = "conversation_index", scorer: Scorer | None = None) -> DataFrame:
    """Sums by key and event-time window; rows later than the watermark are dropped, as watermarks do."""
    c: Column = (scorer or lexicon_scorer())("text")["compound"]
    return stream.withWatermark(at, late).withColumn("c", c).groupBy(key, F.window(at, width)).agg(F.count("*").alias("n"), F.sum("c").alias("valence"))


def vectors(stored: DataFrame, key: str = "conversation_index", length_cap: float = 200.0) -> DataFrame:
    n = F.col("n")
    return stored.select(key, F.round(F.col("valence") / n, 4).alias("valence"), F.round(F.col("intensity") / n, 4).alias("intensity"), F.round(F.least(F.col("curiosity") / n, F.lit(1.0)), 4).alias("curiosity"), F.round(F.least(F.col("size") / n / length_cap, F.lit(1.0)), 4).alias("avg_length"))

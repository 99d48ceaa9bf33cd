"""A positional inverted index: which texts hold a word or phrase, without reading the texts.

Postings (word, source, key, field, at) are Parquet partitioned by `bucket`, a hash of the word, and by `batch`; beside them
lie the document frequencies of each batch and a manifest of the batches that are whole. An append writes one batch under a new name and then its
line in the manifest, so readers never see half of one, a failed append leaves nothing that is read, and nothing written before is touched. A lookup reads the buckets of its words only.

Words are runs of Unicode word characters with case folded. A phrase is found where its words stand at consecutive
places of one field of a text. That is a superset of whole-word occurrences of the literal phrase (blanks and signs between
the words aren't kept), so exact users check the texts of the keys found, as `mentions_by_index` does.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sentiment import Scorer
from . import conflict

#: Buckets of the words, and keys of one block: a task writes a bucket's postings of one block.
BUCKETS, BLOCK = 64, 1 << 20
#: Messages of a block of the stored messages.
MESSAGES = 1 << 16
POSTING = "word string, source string, key long, field int, at int"
#: Fixed value: the one letter whose case folding depends on whether letters are folded one by one.
DOTTED = "İ"


def folded(text: Column) -> Column:
    return F.lower(F.upper(F.translate(text, DOTTED, "i")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"(?U)\w+"), F.lit(0))


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def postings(texts: DataFrame) -> DataFrame:
    """(word, source, key, field, at) of rows (source, key, field, text)."""
    return texts.select("source", "key", "field", F.posexplode(words(F.col("text"))).alias("at", "word")).select("word", "source", "key", "field", "at")


def of_messages(messages: DataFrame) -> DataFrame:
    return messages.select(F.lit("message").alias("source"), F.col("global_index").alias("key"), F.lit(0).alias("field"), "text")


def of_topics(topics: DataFrame) -> DataFrame:
    """Label, summary and each key entity of a topic are fields of their own, so no phrase spans two of them."""
    fields = F.concat(F.array("topic_label", "summary"), F.coalesce("key_entities", F.array().cast("array<string>")))
    return topics.select(F.lit("topic").alias("source"), F.col("topic_id").cast("long").alias("key"), F.posexplode(fields).alias("field", "text"))


class Postings:
    """An index below a path. Opening it reads the manifest; batches appended later are seen by opening it again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        try:
            self.batches = sorted(r[0] for r in spark.read.schema("batch string, texts long").parquet(f"{path}/manifest").select("batch").collect())  # one line for each append
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            self.batches = []

    def append(self, texts: DataFrame) -> Postings:
        """The index with the words of further texts (source, key, field, text); their keys must be new to their source."""
        batch = f"b{uuid.uuid4().hex}"
        rows = postings(texts).withColumns({"bucket": bucket(F.col("word")), "batch": F.lit(batch)})
        dealt = rows.repartition("bucket", F.floor(F.col("key") / BLOCK)).sortWithinPartitions("bucket", "word", "source", "key", "field", "at")
        dealt.write.mode("append").partitionBy("bucket", "batch").parquet(f"{self.path}/postings")
        stored = self._stored("postings", POSTING).where(F.col("batch") == batch)
        texts_of = stored.groupBy("bucket", "batch", "word", "source", "key").agg(F.count("*").alias("n"))
        counts = texts_of.groupBy("bucket", "batch", "word").agg(F.count("*").alias("df"), F.sum("n").alias("n"))
        counts.repartition("bucket").write.mode("append").partitionBy("bucket", "batch").parquet(f"{self.path}/frequencies")
        line = texts.agg(F.count("*").alias("texts")).select(F.lit(batch).alias("batch"), "texts")
        line.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return Postings(self.spark, self.path)

    def _stored(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, bucket int, batch string").parquet(f"{self.path}/{name}")

    def _of(self, name: str, schema: str, asked: Sequence[str]) -> DataFrame:
        """Rows of the words asked for, from the partitions of their buckets and of the published batches."""
        if not self.batches or not asked:
            return self.spark.createDataFrame([], f"{schema}, bucket int, batch string")
        places = {r[0] for r in self.spark.createDataFrame([(w,) for w in asked], "w string").select(bucket(F.col("w"))).collect()}
        return self._stored(name, schema).where(F.col("bucket").isin(*places) & F.col("batch").isin(*self.batches) & F.col("word").isin(*asked))

    def folded(self, phrase: str) -> list[str]:
        return self.spark.range(1).select(words(F.lit(phrase))).first()[0]

    def frequencies(self, asked: Sequence[str]) -> DataFrame:
        """(word, df, n): texts that hold each word and how often they do, from the frequency table alone."""
        return self._of("frequencies", "word string, df long, n long", sorted(set(asked))).groupBy("word").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))

    def matches(self, phrase: str) -> DataFrame:
        """(source, key) of the texts that hold the words of the phrase in a row. ValueError if it has none."""
        asked = self.folded(phrase)
        if not asked:
            raise ValueError("the phrase has no word to look up")
        found = self._of("postings", POSTING, sorted(set(asked)))
        if len(asked) > 1:
            starts = F.array_compact(F.array(*[F.when(F.col("word") == w, F.col("at") - i) for i, w in enumerate(asked)]))
            at = found.select("source", "key", "field", F.explode(starts).alias("start"), "at")
            found = at.groupBy("source", "key", "field", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(asked))
        return found.select("source", "key").distinct()


def mentions_by_index(entity: str, index: Postings, messages: DataFrame, topics: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """The rows of conflict.mentions_of, from the texts that the index names; texts are checked, so blanks and signs of the entity count.

    An entity without a word character is in no index: there every text is read.
    """
    if not re.search(r"\w", entity):
        return conflict.mentions_of(entity, messages, topics, scorer)
    keys = index.matches(entity)
    named = lambda source, key: keys.where(F.col("source") == source).select(F.col("key").alias(key))
    found = named("message", "global_index")
    if "block" in messages.columns:  # stored in blocks of global_index: blocks without a key are not read
        found = found.withColumn("block", F.floor(F.col("global_index") / MESSAGES).cast("int"))
    rows = messages.join(found, found.columns, "left_semi")
    some = None if topics is None else topics.join(named("topic", "topic_id"), "topic_id", "left_semi")
    return conflict.mentions_of(entity, rows, some, scorer)

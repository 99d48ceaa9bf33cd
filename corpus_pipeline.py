"""A corpus pipeline of five stages, each applying one operator of loomspark.llm to whole documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next one's docs. The first four return the columns of documents; the last returns the packed
pieces. Nulls, blank texts and extra columns follow the operators' definitions: a document without
letters leaves in the first stage, so later stages see none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import language_id, ngram_join, packing, pii, quality
from loomspark.llm.shared import cut, discard

#: Posterior of the predicted language below which a document is rejected.
LEAST_SCORE = 0.5
#: Near-duplicates: words of a shingle and least Jaccard similarity in percent.
WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognisable language; the trees are fitted on a bounded sample of labelled rows."""
    found = language_id.identify(docs, language_id.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the threshold table."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate component; of rows that repeat an id, the one whose text is first in order, before anything is compared."""
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        row, order = F.struct(*docs.columns), F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*docs.columns))
        first = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("row"))
        docs = docs.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select("row.*"))
    named = ngram_join.near_duplicates(docs, words=WORDS, percent=PERCENT)
    losers = named.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(losers, "doc_id", "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; n_chars follows."""
    clean = pii.redact(pii.label(docs, pii.fit(docs))).drop("pii")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens."""
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("language ID", language), ("quality rules", rules), ("n-gram Jaccard join", one_of_each), ("PII", redact), ("best-fit packing", pack)]

#: PPM, EM and packing have no SQL form; tests/llm checks the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)

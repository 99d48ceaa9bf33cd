"""The queries of this package and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, html_text, katz, language_id, line_dedup, ngram_join, packing, periodic_runs, pii, quality, sentencepiece_viterbi, vector_join, warc
from .oracles import ORACLE_SQL  # noqa: F401
from .shared import remainder, shared_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM trees fitted on rows outside fold 0 of 5, applied to every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = language_id.fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    return language_id.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz bigrams learned outside fold 2 of 7, scoring every document."""
    fold = remainder(F.col("doc_id"), 7)
    out = katz.score(read(spark, sf_dir, "documents"), fold != 2)
    return out.withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the best-scoring pieces and decoded again."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepiece_viterbi.transcode(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return out.select("doc_id", F.col("n_ids").alias("n_tokens"), "ids_crc32", "score", "round_trip")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives in the shared folder and read back."""
    archives = warc.write(read(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc")
    ends = warc.read(archives).where("last")
    return ends.select(F.col("record").alias("page_id"), F.col("size").alias("payload_bytes"), F.when(F.col("kind") == "response", F.col("running")).otherwise(F.col("digest")).alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epsilon grid order join of all embeddings within labels at cosine 0.93."""
    return vector_join.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.93)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; the label model is fitted on all of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.label(docs, pii.fit(docs))
    base = F.filter("pii", lambda x: x["base"])
    counts = [pii.counted(base, k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: four-word shingles, similarity 0.85."""
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=85)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold table on every document."""
    out = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by wrapper induction over its host's pages."""
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised and packed into sequences of at most 4096 tokens."""
    docs = read(spark, sf_dir, "documents")
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on all documents, replayed in all 120 orders."""
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that stand in an earlier one as well are dropped."""
    out = line_dedup.deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=10, least_docs=2)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, a tenth of which get a repeated end."""
    docs = read(spark, sf_dir, "documents").select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text"))
    out = periodic_runs.detect(docs)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_katz_backoff, op3_sentencepiece, op4_warc, op5_embedding_near_dedup, op6_pii, op7_ngram_jaccard_join, op8_quality_rules, op9_html_extraction, op10_best_fit_packing, op11_filter_audit, op12_line_dedup, op13_periodic_runs)}

"""Vector retrieval over stored indices, with a keyword rerank of what was retrieved."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.text import query_words
from ..functions.vectors import Embedder, dot, hashing_embedder, unit


def vector_index(rows: DataFrame, text: Column, embedder: Embedder | None = None, vector: str = "vec") -> DataFrame:
    """rows with a unit vector of the text, ready to be stored as Parquet."""
    return rows.withColumn("__text", text).withColumn(vector, (embedder or hashing_embedder())("__text")).drop("__text")


def topic_index(topics: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    return vector_index(topics, F.concat_ws(". ", "topic_label", "summary"), embedder)


def chunk_index(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    return vector_index(chunks, F.col("text"), embedder)


def checkpoint_index(checkpoints: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    return vector_index(checkpoints, F.col("summary"), embedder)


def top_k(index: DataFrame, query: Sequence[float], k: int, key: str, vector: str = "vec", normalise: bool = False) -> DataFrame:
    """The k rows with the largest inner product, ties by key: one scan and a bounded heap per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return index.withColumn("relevance_score", dot(unit(F.col(vector)) if normalise else F.col(vector), q)).orderBy(F.desc("relevance_score"), key).limit(k)


def packed(rows: DataFrame, key: str, vector: str, most: int, of: str | None = None) -> DataFrame:
    """(keys, dim, data): rows as blocks of at most `most`, in order of key, with their vectors end to end; dim -1 holds those that have nulls.

    With `of`, an integer column, no block has rows of two of its values, and it is the first column.
    """
    kind = rows.schema[key].dataType.simpleString()
    out = [("keys", f"array<{kind}>"), ("dim", "int"), ("data", "binary")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, sort_keys=[("k", "ascending")], null_placement="at_start"))
            held, group = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            dims = np.array([-1 if v is None or None in v else len(v) for v in held], np.int64)
            for part_of, dim in sorted(set(zip(group.tolist(), dims.tolist(), strict=True))):
                mine, step = np.flatnonzero((dims == dim) & (group == part_of)), max(1, min(most, (1 << 20) // max(1, int(dim))))
                for at in range(0, len(mine), step):
                    part = mine[at : at + step]
                    data = np.array([held[i] for i in part], np.float64).tobytes() if dim > 0 else b""
                    keys = batch.column(0).take(pa.array(part))
                    columns = [pa.array([part_of], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), keys), pa.array([dim], pa.int32()), pa.array([data], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["of", *[n for n, _ in out]])

    made = rows.select(F.col(key).alias("k"), F.col(vector).alias("v"), (F.col(of) if of else F.lit(0)).cast("int").alias("g")).mapInArrow(run, "of int, " + ", ".join(f"{n} {t}" for n, t in out))
    return made.withColumnRenamed("of", of) if of else made.drop("of")


def nearest(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, the first of equal ones; NaN is larger than any number, as in Spark."""
    if len(scores) <= k:
        return np.arange(len(scores))
    if np.isnan(scores).any():
        return np.lexsort((-scores, ~np.isnan(scores)))[:k]
    least = np.partition(scores, -k)[-k]
    above = np.flatnonzero(scores > least)
    return np.r_[above, np.flatnonzero(scores == least)[: k - len(above)]]


def scores_of(batches: Iterator[pa.RecordBatch], k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(query, key, score) of the k best a query of each pair of blocks (keys, dim, data, asked, asked_dim, wanted); null scores where lengths differ."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys, dim, data, asked, asked_dim, wanted = (batch.column(c)[i] for c in range(6))
            n, m, d = len(keys), len(asked), dim.as_py()
            if d == asked_dim.as_py() and d >= 0:
                a, b = np.frombuffer(wanted.as_buffer(), np.float64).reshape(m, d), np.frombuffer(data.as_buffer(), np.float64).reshape(n, d)
                scores = np.zeros((m, n))
                for x, y in zip(a.T, np.ascontiguousarray(b.T), strict=True):  # one component after the other, so equal vectors have equal scores
                    scores += x[:, None] * y
                found = [nearest(s, k) for s in scores]
                value = pa.array(np.concatenate([s[f] for s, f in zip(scores, found, strict=True)]), pa.float64(), from_pandas=False)
            else:
                found = [np.arange(min(n, k))] * m
                value = pa.nulls(sum(map(len, found)), pa.float64())
            of = np.repeat(np.arange(m), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([asked.values.take(pa.array(of)), keys.values.take(pa.array(np.concatenate(found))), value], names=names)


def met_in_spans(index: DataFrame, queries: DataFrame, spans: int, asked: int, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """fn over each pair of blocks (keys, dim, data) of the index and of the queries.

    Blocks are dealt into `spans` and `asked` spans by their keys. Each pair of spans is a group that holds the blocks of either side once, so
    what a task takes in is bounded by the spans and no row carries a pair of blocks.
    """
    span = lambda n: F.pmod(F.xxhash64("keys", "dim"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select(span(spans).alias("i"), "keys", "dim", "data").withColumn("j", every(asked))
    right = queries.select(span(asked).alias("j"), "keys", "dim", "data").withColumn("i", every(spans))

    def pairs(v: pa.Table, q: pa.Table) -> Iterator[pa.RecordBatch]:
        theirs = [b.slice(r, 1) for b in q.select(["keys", "dim", "data"]).to_batches() for r in range(b.num_rows)]
        for b in v.select(["keys", "dim", "data"]).to_batches():
            for r in range(b.num_rows):
                for other in theirs:
                    yield pa.RecordBatch.from_arrays([*b.slice(r, 1).columns, *other.columns], names=["keys", "dim", "data", "asked", "asked_dim", "wanted"])

    def run(v: pa.Table, q: pa.Table) -> pa.Table:
        return pa.Table.from_batches([b.cast(out) for b in fn(pairs(v, q))], out)

    out = to_arrow_schema(schema)
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, schema)


def top_k_batch(index: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, vector: str = "vec", block: int = 4096) -> DataFrame:
    """(query_key, rank, key, score): the k nearest rows of each query, of any number of queries.

    Queries are dealt into partitions of `block`; spans of them and spans of the index, of about `block` vectors each, meet in groups, and
    each pair of blocks keeps its k best a query before anything is sorted.
    """
    spans, asked = (max(1, -(-rows.count() // block)) for rows in (index, queries))
    dealt = queries.repartition(asked)
    q, v = packed(dealt, query_key, vector, 64), packed(index, key, vector, 2048)
    names = {query_key: queries.schema[query_key].dataType, key: index.schema[key].dataType}

    schema = T.StructType([*[T.StructField(c, t) for c, t in names.items()], T.StructField("score", T.DoubleType())])
    pairs = met_in_spans(v, q, spans, asked, lambda batches: scores_of(batches, k, [query_key, key, "score"]), schema)
    order = [F.desc("score"), F.col(key)]
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy(query_key).orderBy(*order))).where(F.col("r") <= k)
    return near.select(query_key, F.col("r").alias("rank"), key, "score")


def keyword_scored(found: DataFrame, question: str, field: str, boost: float = 0.1) -> DataFrame:
    """found with boost added to relevance_score for each distinct query word that its field contains; one projection, no order."""
    words = query_words(question)
    low = F.lower(F.coalesce(F.col(field), F.lit("")))
    hit = reduce(Column.__add__, [low.contains(w).cast("int") for w in words], F.lit(0))
    return found.withColumn("relevance_score", F.col("relevance_score") + boost * hit)


def keyword_rerank(found: DataFrame, question: str, field: str, key: str, boost: float = 0.1) -> DataFrame:
    """found in order of score + boost per distinct query word that its field contains; unchanged without words. For results of a search, which are few."""
    if not query_words(question):
        return found
    scored = keyword_scored(found.withColumn("__was", F.col("relevance_score")), question, field, boost)
    return scored.orderBy(F.desc("relevance_score"), F.desc("__was"), key).drop("__was")


def retrieve(question: str, query: Sequence[float], topics: DataFrame, chunks: DataFrame, checkpoints: DataFrame, top: int = 5) -> dict[str, DataFrame]:
    """Topics, messages and checkpoints for a question: k, 2k and k by vector, reranked, cut to k, k and 3."""
    t = keyword_rerank(top_k(topics, query, top, "topic_id"), question, "summary", "topic_id").limit(top)
    m = keyword_rerank(top_k(chunks, query, 2 * top, "chunk_id"), question, "text", "chunk_id").limit(top)
    return {"topics": t, "messages": m, "checkpoints": top_k(checkpoints, query, top, "checkpoint_id").limit(3)}


def page(rows: DataFrame, by: str, number: int, size: int) -> DataFrame:
    """The rows of one page in order of `by`; pages count from 1."""
    if number < 1 or size < 1:
        raise ValueError("page and per_page start at 1")
    return rows.orderBy(by).offset((number - 1) * size).limit(size)

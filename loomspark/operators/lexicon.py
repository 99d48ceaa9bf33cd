"""Keyword tables of any size: which texts contain which keywords, as substrings, with case folded.

A table (keyword, category, place) takes the place of lists in code. Its bytes are summed first. A table of at most AT_MOST bytes is broadcast and
compiled in each task into one automaton that finds all keywords in one pass over a text, whatever their number. A larger one isn't
sent anywhere: keywords and texts are joined on the first GRAM letters of a keyword (or all of a shorter one), and
whole keywords are compared where those agree. Both ways give the same rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes of keywords that are broadcast, and letters by which larger tables are joined.
AT_MOST, GRAM = 16 << 20, 4
#: Bytes of rows repeated for their keywords that a task holds at once.
HELD = 4 << 20


def table(spark: SparkSession, lexicon: Mapping[str, Sequence[str]]) -> DataFrame:
    """A keyword table of lists in code, categories in order."""
    return spark.createDataFrame([(w, k, i) for i, (k, words) in enumerate(lexicon.items()) for w in words], "keyword string, category string, place int")


class Automaton:
    """Goto, failure and output links over the letters of the keywords; a text is walked once."""

    def __init__(self, keywords: Sequence[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        for i, w in enumerate(keywords):
            node = 0
            for c in w:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.word.append(-1)
                node = self.next[node][c]
            self.word[node] = i
        self.fail, self.out = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                at = self.fail[node]
                while at and c not in self.next[at]:
                    at = self.fail[at]
                self.fail[child] = self.next[at].get(c, 0) if node else 0
                self.out[child] = self.fail[child] if self.word[self.fail[child]] >= 0 else self.out[self.fail[child]]
                queue.append(child)

    def found(self, text: str) -> list[int]:
        """The numbers of the keywords that the text contains, in order."""
        node, seen = 0, set()
        for c in text:
            while node and c not in self.next[node]:
                node = self.fail[node]
            node = self.next[node].get(c, 0)
            at = node if self.word[node] >= 0 else self.out[node]
            while at and self.word[at] not in seen:  # what follows a keyword seen before has been seen with it
                seen.add(self.word[at])
                at = self.out[at]
        return sorted(seen)


def contained(rows: DataFrame, text: str, keywords: DataFrame, at_most: int | None = None) -> DataFrame:
    """rows with keyword, category and place: one row for each keyword that the text contains. Null texts and null or empty keywords match nothing."""
    limit = AT_MOST if at_most is None else at_most
    known = keywords.where("keyword <> ''").select(F.lower("keyword").alias("keyword"), "category", "place").distinct()
    size, lengths = known.agg(F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0)), F.sort_array(F.collect_set(F.least(F.length("keyword"), F.lit(GRAM))))).first()  # at most GRAM lengths
    hits = by_automaton(rows, text, known) if size <= limit else by_grams(rows, text, known, lengths)
    return hits


def by_automaton(rows: DataFrame, text: str, known: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    words = sorted({r["keyword"] for r in known.select("keyword").distinct().collect()})  # bounded by the caller
    shared, n = spark.sparkContext.broadcast(words), len(rows.columns)
    schema = T.StructType([*rows.schema.fields, T.StructField("keyword", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        machine = Automaton(words)

        def repeated(batch: pa.RecordBatch, of: list[int], found: list[int]) -> pa.RecordBatch:
            at = pa.array(of, pa.int64())
            return pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(n)], pa.array([words[w] for w in found], pa.string())], names=schema.names)

        for batch in batches:
            of, found, held = [], [], 0
            for i, t in enumerate(batch.column(n)):
                hits = machine.found(t.as_py()) if t.is_valid else []
                each = max(1, batch.slice(i, 1).nbytes)
                for w in hits:
                    of.append(i)
                    found.append(w)
                    held += each
                    if held >= HELD:
                        yield repeated(batch, of, found)
                        of, found, held = [], [], 0
            if of:
                yield repeated(batch, of, found)

    hit = rows.select("*", F.lower(F.col(text)).alias("__low")).mapInArrow(run, schema)
    return hit.join(F.broadcast(known), "keyword").select(*rows.columns, "keyword", "category", "place")


def by_grams(rows: DataFrame, text: str, known: DataFrame, lengths: Sequence[int] = tuple(range(1, GRAM + 1))) -> DataFrame:
    """Texts are exploded to their grams of each length in use; a gram of a row and its keywords meet once for each place."""
    low = F.lower(F.col(text))
    used = F.array(*[F.lit(i) for i in lengths])
    places = F.when(F.length("__low") > 0, F.sequence(F.lit(1), F.length("__low")))
    gram = lambda at, size: F.substring(F.col("__low"), at, size)
    cut = F.array_distinct(F.flatten(F.transform(places, lambda at: F.transform(used, lambda size: gram(at, size)))))
    texts = rows.select("*", low.alias("__low")).withColumn("__gram", F.explode(cut))
    keyed = known.withColumn("__gram", F.left("keyword", F.lit(GRAM)))
    return texts.join(keyed, "__gram").where(F.contains("__low", "keyword")).select(*rows.columns, "keyword", "category", "place")


def first_category(rows: DataFrame, group: str, at: str, text: str, keywords: DataFrame, quotes: int = 3, at_most: int | None = None) -> DataFrame:
    """(group, value, evidence): the category with the smallest place that a row of the group contains, and its first rows in order of `at`."""
    hits = contained(rows.select(group, at, text, F.left(text, F.lit(100)).alias("quote")), text, keywords, at_most).select(group, at, "quote", "category", "place").distinct()
    best = hits.groupBy(group).agg(F.min(F.struct("place", "category")).alias("best"))
    mine = hits.join(best, group).where("place = best.place AND category = best.category")
    ranked = mine.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(at))).where(F.col("__r") <= quotes)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("idx"), "quote"))), shown)
    return ranked.groupBy(group).agg(F.first("category").alias("value"), listed.alias("evidence"))


def shown(x: Column) -> Column:
    return F.struct(x["idx"].alias("idx"), x["quote"].alias("quote"))

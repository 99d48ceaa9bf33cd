"""Filter interaction audit: what each filter of a chain removes, in every order the filters can take.

The replay is relational and direct. Each document's failure flags meet all orders of the filters (k! rows, broadcast:
120 for five filters, and k is at most MOST), the place of the first failing filter is computed once for each
document and order, the k steps are exploded, and conditional sums by (part, order, step) are taken, partial sums first. A
task sends at most one row for each part, order and step, however many documents it has.

Whether a text repeats is found without grouping texts: the smallest id of each text digest comes from partial minima, and a
document is original if it is that (digest, id), so copies never meet in one task.

Defined results: null text is the empty text; it fails A only and repeats other empty texts. Null parts are the
empty string. A row without id has no smaller one, so it fails no E and makes no other fail; rows with equal ids and texts are all original.
Repeated rows are counted each. A document has a mark if any row of `labels` with its id says so; null ids have none. Columns other than the
named ones are not read. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import SPACE, bound

#: Filters of one audit; their orders are broadcast.
MOST = 7
#: Bounds of the five filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
MARKS = ("good", "toxic")


def text_flags(text: Column) -> Column:
    """Struct of the flags A to D of a text, true where it fails."""

    def told(t: Column) -> Column:
        words = F.array_remove(F.split(t, SPACE), "")
        capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
        counts = bound(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
        flags = lambda c: F.struct((c["n"] < LEAST_WORDS).alias("A"), (100 * c["d"].cast("long") < LEAST_DISTINCT * c["n"].cast("long")).alias("B"))
        return F.struct(bound(counts, flags).alias("ab"), (100 * capitals.cast("long") > MOST_CAPITALS * F.length(t).cast("long")).alias("C"), t.rlike(SYMBOLS).alias("D"))

    return bound(F.coalesce(text, F.lit("")), told)


def flagged(docs: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, part, A, B, C, D, E): the five flags of each row."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text_flags(F.col(f"`{text}`")).alias("f"), F.unhex(F.sha2(value, 256)).alias("digest"))
    first = docs.select(F.col(f"`{doc_id}`").alias("id"), F.unhex(F.sha2(value, 256)).alias("digest")).where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    plain = ("part", F.col("f.ab.A").alias("A"), F.col("f.ab.B").alias("B"), F.col("f.C").alias("C"), F.col("f.D").alias("D"))
    ided = rows.where("id IS NOT NULL").join(first, ["id", "digest"], "left").select("id", *plain, F.col("first").isNull().alias("E"))
    return ided.unionByName(rows.where("id IS NULL").select("id", *plain, F.lit(False).alias("E")))


def marked(flags: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """flags with good and toxic from labels."""
    told = labels.select(F.col(f"`{doc_id}`").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id IS NOT NULL AND (good OR toxic)")
    each = told.groupBy("id").agg(*[F.max(F.coalesce(m, F.lit(False))).alias(m) for m in MARKS])
    has = flags.where("id IS NOT NULL").join(each, "id", "left")
    none = flags.where("id IS NULL").withColumns({m: F.lit(False) for m in MARKS})
    return has.withColumns({m: F.coalesce(m, F.lit(False)) for m in MARKS}).unionByName(none)


def replay(flags: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of rows with part, good, toxic and one flag a filter."""
    if not 0 < len(filters) <= MOST:
        raise ValueError(f"an audit takes 1 to {MOST} filters")
    k = len(filters)
    orders = flags.sparkSession.createDataFrame([("".join(filters[i] for i in p), list(p)) for p in permutations(range(k))], "filter_order string, places array<int>")
    failing = F.array(*[F.col(f"`{f}`") for f in filters])
    rows = flags.select("part", *MARKS, failing.alias("fails"), reduce(Column.__add__, [F.col(f"`{f}`").cast("int") for f in filters]).alias("n_fails"))
    # a few bytes become k! * k rows, which no coalescing of partitions by bytes foresees; so rows are dealt over all of them
    dealt = rows.repartition(int(flags.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    crossed = dealt.crossJoin(F.broadcast(orders))
    first = F.coalesce(*[F.when(F.col("fails")[F.col("places")[i]], F.lit(i + 1)) for i in range(k)], F.lit(k + 1))
    steps = crossed.withColumn("first", first).select("part", "filter_order", "first", *MARKS, "n_fails", "fails", F.posexplode("places").alias("at", "place"))
    step = F.col("at") + 1
    fails, removed = F.col("fails")[F.col("place")], F.col("first") == step
    counted = {
        "kept": F.col("first") > step,
        "removed": removed,
        "redundant": fails & (F.col("first") < step),
        "unique_fails": fails & (F.col("n_fails") == 1),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    told = steps.groupBy("part", "filter_order", step.alias("step")).agg(*[F.count_if(c).alias(name) for name, c in counted.items()])
    told = told.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    share = F.sum("removed").over(Window.partitionBy("part", "filter"))  # k! sums each
    return told.withColumn("shapley", share).select("part", "filter_order", F.col("step").cast("int").alias("step"), *counted, "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The five filters A to E on docs, replayed in all 120 orders."""
    return replay(marked(flagged(docs, part), labels), "ABCDE")

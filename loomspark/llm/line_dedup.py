"""Line deduplication: lines that stand in several documents stay only in the first of them.

Normalised lines are exploded and hashed, distinct documents are counted for each hash, and each document is put together
again from the lines that it keeps, in their order. A line's key is the line without the six ASCII blanks at both ends, A-Z
lower-cased. Keys of at least `least_chars` code points that at least `least_docs` documents hold are
dropped everywhere but in the document with the smallest id that holds them; that one keeps all its lines of the key.

Keys travel as two independent 64-bit hashes. Documents are counted by (hash, document) first, which no frequent line can skew, and
then by hash, after partial sums. The HEAVY most frequent hashes meet the lines by broadcast, the others in a
shuffle: since none of those has more rows than any heavy one, none can have more than one in HEAVY + 1 of all rows.

Defined results: null and empty texts are one empty line, which is kept (it is shorter than any least_chars
of 1 or more). Rows with equal ids are one document, each of them put together on its own. A row without id
is no document: it keeps all its lines and makes no other row lose any. A line that a document repeats is kept or dropped in all its places.
Texts are taken whole. Other columns pass through; those named like an output are replaced. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound

BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of the one broadcast: the most frequent dropped keys.
HEAVY = 10_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def folded(line: Column) -> Column:
    """A-Z as a-z and nothing else; lower() is that for lines of ASCII alone, and faster."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, UPPER.lower()))


def lost(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """(id, t, gone): the places of the lines that the rows of an id and a text hash lose, in order; docs has id, t and text."""
    placed = docs.where("id IS NOT NULL").select("id", "t", F.posexplode(lines_of(F.col("text"))).alias("at", "line")).withColumn("line", F.btrim("line", F.lit(BLANKS)))
    long = placed.where(F.length("line") >= least_chars).withColumn("key", folded(F.col("line")))
    lines = long.select("id", "t", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    common = lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first")).where(F.col("n") >= least_docs)
    heavy = F.broadcast(common.orderBy(F.desc("n"), "h1", "h2").limit(HEAVY).select("h1", "h2", F.col("first").alias("heavy")))
    told = lines.join(heavy, ["h1", "h2"], "left")
    often = told.where("id <> heavy").select("id", "t", "at")
    seldom = told.where("heavy IS NULL").join(common, ["h1", "h2"]).where("id <> first").select("id", "t", "at")
    return often.unionByName(seldom).groupBy("id", "t").agg(F.array_sort(F.collect_set("at")).alias("gone"))


def stretches(lines: Column, gone: Column) -> Column:
    """What is left between the places in `gone`, as one array; linear in both."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    return bound(edges, lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: F.slice(lines, e[k] + 2, e[k + 1] - e[k] - 1))))


def deduplicate(docs: DataFrame, least_chars: int = 10, least_docs: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and kept_text."""
    if least_chars < 1 or least_docs < 2:
        raise ValueError("least_chars starts at 1 and least_docs at 2")
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    t = F.xxhash64(F.col(f"`{text}`"))
    gone = lost(docs.select(F.col(f"`{doc_id}`").alias("id"), t.alias("t"), F.col(f"`{text}`").alias("text")), least_chars, least_docs)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), t.alias("t"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))

    def kept(x: Column) -> Column:
        left = F.when(x["gone"].isNull(), x["lines"]).otherwise(stretches(x["lines"], x["gone"]))
        return bound(left, lambda y: F.struct(F.size(x["lines"]).alias("n"), F.size(y).alias("stay"), F.array_join(y, "\n").alias("kept")))

    ided = rows.where("id IS NOT NULL").join(gone, ["id", "t"], "left").select("row", "gone")
    loose = rows.where("id IS NULL").select("row", F.lit(None).cast("array<int>").alias("gone"))
    told = ided.unionByName(loose).select("row", bound(F.struct(lines_of(F.col("row")[text]).alias("lines"), "gone"), kept).alias("told"))
    n = F.col("told.n").cast("long")
    return told.select(*[F.col("row")[c].alias(c) for c in rest], n.alias("n_lines"), (n - F.col("told.stay")).alias("n_dropped"), F.col("told.kept").alias("kept_text"))

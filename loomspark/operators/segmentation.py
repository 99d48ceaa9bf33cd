"""Topic segmentation over the ordered message stream, without a single-partition window.

Windows run inside blocks of the dense index. A row near a block's edge is also given to the
neighbour, so that every frame is whole; only a block's own rows are kept. The greedy minimum-gap
rule needs of the past only how far back the last accepted candidate lies, up to `gap`. So each block
of candidates is a map of gap states; the maps of GROUP blocks are composed into one, the groups'
maps give the state each group starts in, then each block's, then the accepted candidates. No step
holds more than one block, one group of blocks, or a number for each group, one for GROUP * SPAN messages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as lex
from ..functions.text import alpha_tokens, contains_any, names, without
from ..functions.vectors import added, cosine

BLOCK = 4096
#: Positions in a block of the gap rule, and blocks in a group.
SPAN, GROUP = 512, 4096
WIDTH = 5
THRESHOLD = 0.45
GAP = 3


def haloed(rows: DataFrame, at: str, halo: int, block: int = BLOCK) -> DataFrame:
    """rows with block and own; a row within `halo` of an edge also belongs to the next block, not as its own."""
    blocks = F.array_distinct(F.array(*[F.floor((F.col(at) + d) / block) for d in (-halo, 0, halo)]))
    return rows.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == F.floor(F.col(at) / block))


def vector_sum(column: str, window: Window) -> Column:
    return F.aggregate(F.collect_list(column).over(window), F.lit(None).cast("array<double>"), added)


def centroid_similarity(rows: DataFrame, at: str, vector: str, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(at, sim): cosine of the mean of rows [i-width+1, i] and of [i+1, i+width], for every i but the last.

    Sums have the same angle as means. Halo: width rows; the smoothing brings one more.
    """
    h = haloed(rows.select(at, F.transform(vector, lambda x: x.cast("double")).alias("v")), at, width + 1, block)
    w = Window.partitionBy("block").orderBy(at)
    both = h.select(at, "own", vector_sum("v", w.rowsBetween(-width + 1, 0)).alias("left"), vector_sum("v", w.rowsBetween(1, width)).alias("right"))
    return both.where("own AND right IS NOT NULL").select(at, cosine(F.col("left"), F.col("right")).alias("sim"))


def smoothed(sims: DataFrame, at: str, sim: str = "sim", block: int = BLOCK) -> DataFrame:
    """sims with the centred mean of three; a series of fewer than three is left as it is."""
    n = sims.groupBy().agg(F.count("*").alias("n"))
    w = Window.partitionBy("block").orderBy(at).rowsBetween(-1, 1)
    h = haloed(sims, at, 1, block).withColumn("mean", F.avg(sim).over(w)).where("own").drop("block", "own")
    return h.crossJoin(F.broadcast(n)).withColumn("smoothed", F.when(F.col("n") < 3, F.col(sim)).otherwise(F.col("mean"))).drop("mean", "n")


def stepped(number: Column, states: Column, function: Column, before: Column, gap: int) -> Column:
    """The states after one more block: its map applied, after a gap in the numbers to the state `gap`."""
    return F.transform(states, lambda d: F.element_at(function, F.when(number == before + 1, d).otherwise(gap)))


def composed(listed: Column, first: Column, last: Column, gap: int) -> Column:
    """The map of blocks `first` to `last` from those of its blocks that hold candidates, a sorted array of (n, f)."""
    start = F.struct((first - 1).alias("n"), F.sequence(F.lit(1), F.lit(gap)).alias("f"))
    end = F.aggregate(listed, start, lambda acc, x: F.struct(x["n"].alias("n"), stepped(x["n"], acc["f"], x["f"], acc["n"], gap).alias("f")))
    return F.transform(F.array(end), lambda e: F.when(e["n"] == last, e["f"]).otherwise(F.array_repeat(F.lit(gap), gap)))[0]


def entries(listed: Column, first: Column, state: Column, gap: int) -> Column:
    """(n, d): the state in which each block of a sorted array of (n, f) starts, `state` being that of block `first`."""
    none = F.array().cast("array<struct<n:bigint,d:int>>")
    start = F.struct((first - 1).alias("n"), state.cast("int").alias("d"), none.alias("all"))

    def step(acc: Column, x: Column) -> Column:
        d = F.when(x["n"] == acc["n"] + 1, acc["d"]).otherwise(gap).cast("int")
        return F.struct(x["n"].alias("n"), F.element_at(x["f"], d).cast("int").alias("d"), F.array_append(acc["all"], F.struct(x["n"].alias("n"), d.alias("d"))).alias("all"))

    return F.aggregate(listed, start, step)["all"]


def spaced(candidates: DataFrame, at: str, gap: int = GAP, block: int = SPAN, group: int = GROUP) -> DataFrame:
    """The accepted positions: each candidate at least `gap` after the last accepted one; the first is accepted.

    A state d is how far before a block's start the last accepted candidate lies, gap standing for all further back.
    """
    if block < gap:
        raise ValueError("a block must hold at least gap positions")
    held = candidates.select(F.col(at).cast("long").alias("c")).withColumn("n", F.floor(F.col("c") / block)).groupBy("n").agg(F.array_sort(F.collect_set("c")).alias("c"))
    start = F.col("n") * block
    last = lambda d: F.aggregate("c", start - d, lambda l, c: F.when(c - l >= gap, c).otherwise(l))
    maps = held.withColumn("f", F.transform(F.sequence(F.lit(1), F.lit(gap)), lambda d: F.least(F.lit(gap), start + block - last(d)).cast("int")))
    grouped = maps.groupBy(F.floor(F.col("n") / group).alias("g")).agg(F.array_sort(F.collect_list(F.struct("n", "f"))).alias("fs"))
    whole = grouped.select("g", composed(F.col("fs"), F.col("g") * group, (F.col("g") + 1) * group - 1, gap).alias("f"))
    every = whole.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("g").alias("n"), "f"))).alias("fs")).where(F.size("fs") > 0)
    states = every.select(F.inline(entries(F.col("fs"), F.col("fs")[0]["n"], F.lit(gap), gap))).toDF("g", "state")
    inner = grouped.join(states, "g").select(F.inline(entries(F.col("fs"), F.col("g") * group, F.col("state"), gap)))

    def take(acc: Column, c: Column) -> Column:
        ok = c - acc["last"] >= gap
        return F.struct(F.when(ok, c).otherwise(acc["last"]).alias("last"), F.when(ok, F.array_append(acc["all"], c)).otherwise(acc["all"]).alias("all"))

    none = F.struct((start - F.col("d")).cast("long").alias("last"), F.array().cast("array<bigint>").alias("all"))
    return held.join(inner, "n").select(F.explode(F.aggregate("c", none, take)["all"]).alias(at))


def before_blocks(totals: DataFrame, block: str, n: str, group: int = GROUP) -> DataFrame:
    """(block, before): the sum of n over all earlier blocks, by groups of blocks; only the groups' sums meet in one task."""
    sums = totals.groupBy(F.floor(F.col(block) / group).alias("g")).agg(F.sum(n).alias("s"))
    above = sums.select("g", F.coalesce(F.sum("s").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("g").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return totals.withColumn("g", F.floor(F.col(block) / group)).withColumn("inside", inside).join(above, "g").select(block, (F.col("inside") + F.col("above")).alias("before"))


def boundaries(sims: DataFrame, starts: DataFrame, at: str, threshold: float = THRESHOLD, gap: int = GAP, force_starts: bool = False, block: int = BLOCK) -> DataFrame:
    """Segment starts: 0, and positions after a smoothed similarity below the threshold or where a conversation starts.

    force_starts keeps every conversation start whatever the gap.
    """
    low = sims.where(F.col("smoothed") < threshold).select((F.col(at) + 1).alias(at))
    first = starts.groupBy().agg(F.min(at).alias(at)).where(F.col(at).isNotNull())
    found = spaced(low.union(starts.select(at)).union(first).distinct(), at, gap)
    return found.union(starts.select(at)).distinct() if force_starts else found


def segmented(rows: DataFrame, bounds: DataFrame, at: str, block: int = BLOCK) -> DataFrame:
    """rows with topic_id, the number of segment starts up to them, from 0."""
    marked = rows.join(bounds.select(at, F.lit(1).alias("cut")), at, "left").withColumn("block", F.floor(F.col(at) / block))
    n = marked.groupBy("block").agg(F.sum(F.coalesce("cut", F.lit(0))).alias("n"))
    before = before_blocks(n, "block", "n")
    inside = F.sum(F.coalesce("cut", F.lit(0))).over(Window.partitionBy("block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("inside", inside).join(before, "block").withColumn("topic_id", (F.col("inside") + F.col("before") - 1).cast("long")).drop("cut", "block", "inside", "before")


def top_words(rows: DataFrame, group: Sequence[str], at: str, text: str, stop: Sequence[str], n: int, portable: bool = False) -> DataFrame:
    """(group, rank, word, n): the n most frequent words of each group, ties by first occurrence."""
    words = rows.select(*group, at, F.posexplode(without(alpha_tokens(text, portable), stop)).alias("pos", "word"))
    counted = words.groupBy(*group, "word").agg(F.count("*").alias("n"), F.min(F.struct(at, "pos")).alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "first")))
    return ranked.where(F.col("rank") <= n).select(*group, "rank", "word", "n")


def topic_labels(messages: DataFrame, stop: Sequence[str] = lex.STOP_WORDS, portable: bool = False, group: str = "topic_id", at: str = "global_index", without_words: str | None = "General Conversation") -> DataFrame:
    """(topic_id, topic_label): the three most frequent words, title-cased and joined by ' & '. Topics that have no word get `without_words`, or no row if it is None."""
    top = top_words(messages, [group], at, "text", stop, 3, portable)
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: F.initcap(x["word"])), " & ")
    labelled = top.groupBy(group).agg(label.alias("topic_label"))
    if without_words is None:
        return labelled
    return messages.select(group).distinct().join(labelled, group, "left").withColumn("topic_label", F.coalesce("topic_label", F.lit(without_words)))


def ranked_lines(rows: DataFrame, group: str, at: str, line: Column, where: Column, most: int) -> DataFrame:
    """(group, lines): the first `most` lines of each group for which `where` holds, in order."""
    first = rows.where(where).select(group, at, line.alias("line")).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(at))).where(F.col("rank") <= most)
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))


def topics(messages: DataFrame, facts: Sequence[str] = lex.FACT_CUES, stop: Sequence[str] = lex.STOP_WORDS, nested: bool = True) -> DataFrame:
    """One row per segment of messages that carry topic_id: span, count, label, summary, entities, messages."""
    spans = messages.groupBy("topic_id").agg(
        F.min("global_index").alias("start_msg_index"),
        F.max("global_index").alias("end_msg_index"),
        F.count("*").cast("int").alias("message_count"),
        F.array_sort(F.collect_set("speaker")).alias("speakers"),
        *([F.array_sort(F.collect_list(F.struct("global_index", "speaker", "text"))).alias("messages")] if nested else []),
    )
    known = ranked_lines(messages, "topic_id", "global_index", F.col("full_text"), contains_any("text", facts), 8)
    entities = messages.select("topic_id", F.explode(names("text")).alias("x")).groupBy("topic_id").agg(F.slice(F.array_sort(F.collect_set("x")), 1, 10).alias("key_entities"))
    out = spans.join(topic_labels(messages, stop), "topic_id").join(known, "topic_id", "left").join(entities, "topic_id", "left")
    head = F.concat(F.lit("Conversation segment with "), F.col("message_count").cast("string"), F.lit(" messages between "), F.array_join("speakers", ", "), F.lit("."))
    said = F.when(F.size("lines") > 0, F.concat(F.lit("Key information shared:\n"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x)), "\n")))
    out = out.withColumn("summary", F.concat_ws("\n", head, said, F.concat(F.lit("Topics: "), F.col("topic_label"))))
    return out.withColumn("key_entities", F.coalesce("key_entities", F.array().cast("array<string>"))).drop("lines", "speakers")


def detect_topics(messages: DataFrame, vector: str, width: int = WIDTH, threshold: float = THRESHOLD, gap: int = GAP, force_starts: bool = False) -> DataFrame:
    """messages (with a vector column) with topic_id."""
    sims = smoothed(centroid_similarity(messages, "global_index", vector, width), "global_index")
    starts = messages.where("local_index = 0").select("global_index")
    return segmented(messages, boundaries(sims, starts, "global_index", threshold, gap, force_starts), "global_index")

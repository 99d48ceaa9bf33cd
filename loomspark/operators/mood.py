"""Daily mood vectors, labels, drift and the trigger of a drift. A day is a conversation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as lex
from ..functions.sentiment import Scorer, lexicon_scorer
from ..functions.text import blank_tokens, clamp, hits, long_words, occurrences, pattern_count, persons, shout
from .segmentation import haloed

DAY = "conversation_index"


def scored(messages: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """messages with compound, pos and neg."""
    return messages.withColumn("__s", (scorer or lexicon_scorer())("text")).select(*messages.columns, "__s.compound", "__s.pos", "__s.neg")


def mood_vectors(messages: DataFrame, scorer: Scorer | None = None, stress: Sequence[str] = lex.STRESS, humor: Sequence[str] = lex.HUMOR, slang: Sequence[str] = lex.SLANG, length_cap: float = 200.0, max_days: int | None = None) -> DataFrame:
    """(day, message_count, the eight dimensions rounded to four digits); max_days keeps the first days."""
    kept = messages if max_days is None else messages.where(F.col(DAY) < max_days)
    words = blank_tokens(F.lower("text"))
    rows = scored(kept, scorer).select(
        F.col(DAY).alias("day"), "compound", "neg", hits(words, stress).alias("stress"), hits(words, humor).alias("humor"), hits(words, slang).alias("slang"), pattern_count("text", lex.EMOJI).alias("emoji"),
        long_words(words).alias("long"), occurrences("text", ".").alias("dots"), shout("text").cast("int").alias("caps"), occurrences("text", "?").alias("ask"), F.length("text").alias("size"),
    )
    n = F.count("*")
    total = lambda x: F.sum(x) / n
    dims = {
        "valence": F.avg("compound"),
        "intensity": F.avg(F.abs("compound")),
        "frustration": F.least(total(F.col("stress") + (F.col("neg") > 0.3).cast("int")), F.lit(1.0)),
        "playfulness": F.least(total(F.col("humor") + F.col("emoji")), F.lit(1.0)),
        "formality": clamp(total(F.col("long") + F.col("dots") - F.col("slang") - F.col("emoji") - F.col("caps")), -1.0, 1.0),
        "curiosity": F.least(total(F.col("ask")), F.lit(1.0)),
        "emoji_rate": F.least(total(F.col("emoji")), F.lit(1.0)),
        "avg_length": F.least(total(F.col("size")) / length_cap, F.lit(1.0)),
    }
    return rows.groupBy("day").agg(n.alias("message_count"), *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(k) for k, c in dims.items()])


def labels(dims: Sequence[str] = lex.MOOD_DIMS, prototypes: Mapping[str, Mapping[str, float]] = lex.MOOD_PROTOTYPES, least: float = 0.15, most: int = 3) -> Column:
    """Up to `most` prototypes by score, those above `least`, one at least; ties in the order of the table. Scores have nine digits, so sums that are equal stay equal however they are rounded."""
    score = lambda w: reduce(Column.__add__, [F.col(d) * F.lit(v) for d, v in w.items() if d in dims], F.lit(0.0))
    listed = F.array(*[F.struct(F.round(-score(w), 9).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("label")) for i, (k, w) in enumerate(prototypes.items())])
    ranked = F.array_sort(listed)
    return F.transform(F.slice(F.filter(ranked, lambda x, i: (x["s"] < -least) | (i == 0)), 1, most), lambda x: x["label"])


def lagged(days: DataFrame, columns: Sequence[str], block: int = 4096) -> DataFrame:
    """days with the previous day's columns as prev_*; windows stay within blocks of the dense day number."""
    w = Window.partitionBy("block").orderBy("day")
    return haloed(days, "day", 1, block).withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns}).where("own").drop("block", "own")


def drifts(days: DataFrame, dims: Sequence[str] = lex.MOOD_DIMS, k: float = 1.5, label: str | None = "mood_labels") -> DataFrame:
    """days with drift_distance, drift_threshold (mean + k population deviations) and drift_from_prev.

    A day drifts if its distance exceeds the threshold or its first label changes; the first day
    never does and has distance 0 and no threshold if it is the only one.
    """
    packed = days.withColumn("vec", F.array(*[F.col(d).cast("double") for d in dims]))
    before = lagged(packed, ["vec", *([label] if label else [])])
    gap = F.sqrt(F.aggregate(F.zip_with("vec", "prev_vec", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    out = before.withColumn("dist", F.when(F.col("prev_vec").isNotNull(), gap))
    limit = out.agg((F.avg("dist") + k * F.stddev_pop("dist")).alias("thr"))
    changed = F.coalesce(F.get(label, F.lit(0)) != F.get(f"prev_{label}", F.lit(0)), F.lit(False)) if label else F.lit(False)
    flagged = out.crossJoin(F.broadcast(limit)).withColumn("drift_from_prev", F.col("prev_vec").isNotNull() & (F.coalesce(F.col("dist") > F.col("thr"), F.lit(False)) | changed))
    return flagged.select(*days.columns, "drift_from_prev", F.round(F.coalesce("dist", F.lit(0.0)), 4).alias("drift_distance"), F.round("thr", 4).alias("drift_threshold"))


def event_trigger(messages: DataFrame, events: Mapping[str, Sequence[str]] = lex.EVENTS, word_match: bool = False, quotes: int = 3) -> DataFrame:
    """(day, value, evidence): the first event type, in table order, with a keyword in the day's messages."""

    def on(words: Sequence[str]) -> Column:
        low = F.lower("text")
        return reduce(Column.__or__, [low.rlike(rf"\b\Q{w}\E\b") if word_match else low.contains(w) for w in words])

    first = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("type"), on(w).alias("on")) for i, (k, w) in enumerate(events.items())])
    rows = messages.select(F.col(DAY).alias("day"), "global_index", F.left("text", F.lit(100)).alias("quote"), F.inline(F.filter(first, lambda x: x["on"])))
    best = rows.groupBy("day").agg(F.min(F.struct("i", "type")).alias("best"))
    hit = rows.join(best, "day").where("i = best.i")
    ranked = hit.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy("global_index"))).where(F.col("rank") <= quotes)
    return ranked.groupBy("day").agg(F.first("type").alias("value"), quoted("rank").alias("evidence"))


def quoted(rank: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(rank, F.col("global_index").alias("idx"), "quote"))), lambda x: F.struct(x["idx"].alias("idx"), x["quote"].alias("quote")))


def day_persons(messages: DataFrame, find: Callable[[str], Column] = persons) -> DataFrame:
    """(day, people, evidence): the persons of a day, sorted, and its first three mentions."""
    rows = messages.select(F.col(DAY).alias("day"), "global_index", F.left("text", F.lit(100)).alias("quote"), F.posexplode(find("text")).alias("pos", "person"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy("global_index", "pos")))
    return ranked.groupBy("day").agg(F.array_sort(F.collect_set("person")).alias("people"), quoted("rank").alias("all")).select("day", "people", F.slice("all", 1, 3).alias("evidence"))


def person_trigger(messages: DataFrame, days: DataFrame, find: Callable[[str], Column] = persons) -> DataFrame:
    """(day, value, evidence): persons that the previous day did not have, for days that have some."""
    every = days.select("day").join(day_persons(messages, find), "day", "left")
    fresh = lagged(every, ["people"]).withColumn("new", F.array_except("people", F.coalesce("prev_people", F.array().cast("array<string>"))))
    return fresh.where(F.size("new") > 0).select("day", F.array_join("new", ", ").alias("value"), "evidence")


def topic_trigger(messages: DataFrame, topics: DataFrame, ahead: int = 5) -> DataFrame:
    """(day, value): the first topic that starts within the day's messages or up to `ahead` after them.

    Topics find days by equality on blocks of the index; a day lists the blocks that it spans.
    """
    size = 4096
    spans = messages.groupBy(F.col(DAY).alias("day")).agg(F.min("global_index").alias("lo"), (F.max("global_index") + ahead).alias("hi"))
    wide = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    starts = topics.select("topic_id", "start_msg_index", "topic_label", F.floor(F.col("start_msg_index") / size).alias("block"))
    met = wide.join(starts, "block").where("start_msg_index BETWEEN lo AND hi")
    return met.groupBy("day").agg(F.min_by("topic_label", "topic_id").alias("value"))


def content_trigger(messages: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """(day, value, evidence): the message with the largest absolute sentiment, first on ties; a general shift if all are 0."""
    rows = scored(messages, scorer).select(F.col(DAY).alias("day"), "global_index", F.left("text", F.lit(100)).alias("quote"), "compound")
    best = rows.groupBy("day").agg(F.max_by(F.struct("global_index", "quote", "compound"), F.struct(F.abs("compound"), -F.col("global_index"))).alias("b"))
    tone = F.when(F.col("b.compound") > 0, "strong positive sentiment").when(F.col("b.compound") < 0, "strong negative sentiment").otherwise("general tone shift")
    return best.select("day", tone.alias("value"), F.array(F.struct(F.col("b.global_index").alias("idx"), F.col("b.quote").alias("quote"))).alias("evidence"))


def with_triggers(timeline: DataFrame, messages: DataFrame, topics: DataFrame | None = None, events: Mapping[str, Sequence[str]] = lex.EVENTS, scorer: Scorer | None = None) -> DataFrame:
    """timeline with trigger on drift days: event, else person, else topic, else content."""
    hot = messages.join(timeline.where("drift_from_prev").select(F.col("day").alias(DAY)), DAY, "left_semi")
    pieces = [("event", event_trigger(hot, events)), ("person", person_trigger(messages, timeline))]
    if topics is not None:
        pieces.append(("topic", topic_trigger(hot, topics).withColumn("evidence", F.array().cast("array<struct<idx:bigint,quote:string>>"))))
    pieces.append(("content", content_trigger(hot, scorer)))
    out, tried = timeline, []
    for kind, found in pieces:
        out = out.join(found.select("day", F.struct(F.lit(kind).alias("type"), "value", "evidence").alias(f"t_{kind}")), "day", "left")
        tried.append(F.col(f"t_{kind}"))
    return out.select(*timeline.columns, F.when(F.col("drift_from_prev"), F.coalesce(*tried)).alias("trigger"))


def mood_timeline(messages: DataFrame, topics: DataFrame | None = None, max_days: int | None = 500, k: float = 1.5, scorer: Scorer | None = None) -> DataFrame:
    """The stored timeline: day, message_count, mood_labels, mood_scores, drift columns and trigger."""
    days = mood_vectors(messages, scorer, max_days=max_days).withColumn("mood_labels", labels())
    scores = F.create_map(*[x for d in lex.MOOD_DIMS for x in (F.lit(d), F.col(d))])
    full = with_triggers(drifts(days, k=k), messages if max_days is None else messages.where(F.col(DAY) < max_days), topics, scorer=scorer)
    return full.select("day", "message_count", "mood_labels", scores.alias("mood_scores"), "drift_from_prev", "drift_distance", "drift_threshold", "trigger")


def drift_summary(timeline: DataFrame) -> DataFrame:
    """One row: days, drifts, rate to four digits."""
    n, d = F.count("*"), F.count_if("drift_from_prev")
    return timeline.agg(n.alias("total_days"), d.alias("drift_count"), F.round(d / F.greatest(n, F.lit(1)), 4).alias("drift_rate"))


def trigger_histogram(timeline: DataFrame) -> DataFrame:
    return timeline.where("drift_from_prev").groupBy(F.col("trigger.type").alias("type")).agg(F.count("*").alias("n"))

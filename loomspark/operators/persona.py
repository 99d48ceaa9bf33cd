"""Personas by speaker: mined habits and facts, traits, communication style, evidence."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as lex
from ..functions.text import all_matches, blank_tokens, contains_any, hits, length_style, literals, occurrences, pattern_count, rate_level, word_set

Patterns = Mapping[str, Sequence[str]]


def mined(messages: DataFrame, patterns: Patterns, least: int, graded: bool, portable: bool = False) -> DataFrame:
    """(speaker, category, detail, evidence, confidence, place): pattern matches, the first per category and detail prefix.

    Line feeds become blanks first, since a pattern's dot and end mean a whole message. least: shortest
    detail kept. graded: details of up to five characters have confidence medium.
    """
    text = F.lower(F.regexp_replace("text", r"[\r\n]+", " "))
    tried = [F.struct(F.lit(name).alias("category"), F.lit(i).alias("c"), F.lit(j).alias("p"), all_matches(F.col("low"), p).alias("found")) for i, (name, ps) in enumerate(patterns.items()) for j, p in enumerate(ps)]
    each = messages.select("speaker", "global_index", F.left("text", F.lit(200)).alias("evidence"), text.alias("low")).withColumn("x", F.explode(F.filter(F.array(*tried), lambda t: F.size(t["found"]) > 0)))
    rows = each.select("speaker", "global_index", "evidence", "x.category", "x.c", "x.p", F.posexplode("x.found").alias("m", "raw")).withColumn("detail", F.trim("raw")).where(F.length("detail") >= least)
    place = F.struct("global_index", "c", "p", "m")
    first = rows.groupBy("speaker", "category", F.left("detail", F.lit(50)).alias("key")).agg(F.min_by(F.struct("detail", "evidence"), place).alias("x"), F.min(place).alias("place"))
    confidence = F.when(F.length("x.detail") > 5, "high").otherwise("medium") if graded else F.lit("high")
    return first.select("speaker", "category", F.left("x.detail", F.lit(100)).alias("detail"), F.col("x.evidence").alias("evidence"), confidence.alias("confidence"), "place")


def habits(messages: DataFrame, patterns: Patterns = lex.HABIT_PATTERNS) -> DataFrame:
    return mined(messages, patterns, 3, True)


def facts(messages: DataFrame, patterns: Patterns = lex.FACT_PATTERNS) -> DataFrame:
    return mined(messages, patterns, 2, False)


def traits(messages: DataFrame, lexicon: Mapping[str, Sequence[str]] = lex.TRAITS, phrases: bool = False, samples: int = 3, tokens=word_set) -> DataFrame:
    """(speaker, trait, score, occurrence_count, first, evidence_samples).

    Counts are sums over messages of distinct indicator words; score = min(count / max(half the
    speaker's largest count, 1), 1), kept above 0.05. phrases also counts multi-word indicators.
    """

    def found(words: Sequence[str]) -> Column:
        plain = hits(F.col("tokens"), words)
        extra = [F.lower("text").contains(w).cast("int") for w in words if " " in w] if phrases else []
        return sum(extra, plain)

    rows = messages.select("speaker", "global_index", "text", tokens("text").alias("tokens"))
    each = rows.select("speaker", "global_index", "text", F.inline(F.array(*[F.struct(F.lit(t).alias("trait"), F.lit(i).alias("at"), found(w).alias("n")) for i, (t, w) in enumerate(lexicon.items())]))).where("n > 0")
    counted = each.groupBy("speaker", "trait").agg(F.sum("n").alias("occurrence_count"), F.min(F.struct("global_index", "at")).alias("first"))
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("speaker", "trait").orderBy("global_index"))).where(F.col("rank") <= samples)
    shown = top.groupBy("speaker", "trait").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.left("text", F.lit(150)).alias("t")))), lambda x: x["t"]).alias("evidence_samples"))
    most = F.max("occurrence_count").over(Window.partitionBy("speaker"))
    score = F.round(F.least(F.col("occurrence_count") / F.greatest(0.5 * most, F.lit(1.0)), F.lit(1.0)), 3)
    return counted.withColumn("score", score).where("score > 0.05").join(shown, ["speaker", "trait"])


def style(messages: DataFrame, formal: Sequence[str] = lex.FORMAL_WORDS, informal: Sequence[str] = lex.INFORMAL_WORDS, greetings: Sequence[str] = lex.GREETINGS, early: int = 50) -> DataFrame:
    """One row per speaker: averages, counts, rates and the buckets made of them."""
    low = F.lower("text")
    first = F.row_number().over(Window.partitionBy("speaker").orderBy("global_index"))
    opening = messages.withColumn("rank", first).where(F.col("rank") <= early).groupBy("speaker").agg(F.bool_or(low.rlike("^(" + "|".join(greetings) + ")")).alias("uses_greetings"))
    words = blank_tokens(low)
    rows = messages.select(
        "speaker", F.size(words).alias("w"), F.length("text").alias("l"), pattern_count("text", lex.EMOTICONS).alias("emoji"), occurrences("text", "!").alias("bang"), occurrences("text", "?").alias("ask"),
        hits(words, formal).alias("formal"), hits(words, informal).alias("informal"),
    )
    a = rows.groupBy("speaker").agg(F.count("*").alias("message_count"), F.avg("w").alias("avg_words"), F.avg("l").alias("avg_length"), *[F.sum(c).alias(c) for c in ("emoji", "bang", "ask", "formal", "informal")])
    n = F.col("message_count")
    formality = (
        F.when(F.col("informal") > 2 * F.col("formal"), "very informal/casual").when(F.col("informal") > F.col("formal"), "mostly informal").when(F.col("formal") > F.col("informal"), "somewhat formal").otherwise("balanced/neutral")
    )
    out = a.select(
        "speaker", "message_count", F.round("avg_words", 1).alias("avg_words"), F.round("avg_length", 1).alias("avg_length"), length_style(F.col("avg_words")).alias("length_style"),
        F.col("emoji").alias("emoji_count"), F.round(F.col("emoji") / n, 3).alias("emoji_rate"), rate_level(F.col("emoji") / n, 0.5, 0.1, ("heavy", "moderate", "minimal")).alias("emoji_level"),
        F.col("bang").alias("exclamations"), F.round(F.col("bang") / n, 3).alias("exclamation_rate"), F.round(F.col("ask") / n, 3).alias("question_rate"), rate_level(F.col("bang") / n, 1.5, 0.5, ("very expressive (heavy exclamation use)", "moderately expressive", "calm/reserved")).alias("enthusiasm"),
        F.col("ask").alias("questions"), (F.col("ask") > 0.2 * n).alias("asks_questions"), F.col("formal").alias("formal_words"), F.col("informal").alias("informal_words"), formality.alias("formality"),
        F.when(F.col("avg_words") > 10, "engaged").otherwise("brief").alias("responsive_style"),
    )
    return out.join(opening, "speaker")


def evidence(messages: DataFrame, cues: Mapping[str, tuple[Sequence[str], int]] = lex.EVIDENCE) -> DataFrame:
    """(speaker, category, rank, line): the first messages of each category that hold one of its cues."""
    tried = F.array(*[F.struct(F.lit(k).alias("category"), F.lit(n).alias("most"), contains_any("text", words).alias("on")) for k, (words, n) in cues.items()])
    line = F.concat(F.lit("[Msg "), F.col("global_index").cast("string"), F.lit("] "), F.left("text", F.lit(300)))
    rows = messages.select("speaker", "global_index", line.alias("line"), F.inline(F.filter(tried, lambda x: x["on"])))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("speaker", "category").orderBy("global_index")))
    # the literal bound lets each task keep only so many rows a group before the shuffle
    return ranked.where(F.col("rank") <= max((n for _, n in cues.values()), default=0)).where("rank <= most").select("speaker", "category", "rank", "line")


#: Entries of each list of an assembled persona; all of them are rows of details().
LISTED = 1000


def details(messages: DataFrame, habit_patterns: Patterns = lex.HABIT_PATTERNS, fact_patterns: Patterns = lex.FACT_PATTERNS) -> DataFrame:
    """(speaker, kind, category, detail, evidence, confidence, place): every habit and personal fact, one a row, however many a speaker has."""
    kinds = (("habits", habits(messages, habit_patterns)), ("personal_facts", facts(messages, fact_patterns)))
    return reduce(DataFrame.unionByName, [found.select("speaker", F.lit(kind).alias("kind"), "category", "detail", "evidence", "confidence", "place") for kind, found in kinds])


def first_of(rows: DataFrame, key: Sequence[str], by: Sequence[str], fields: Sequence[str], name: str, most: int) -> DataFrame:
    """(key, name, name_count): the first `most` rows of each key as an ordered array of structs, and how many there are.

    Each task keeps its own first `most` rows before the shuffle and sends one count, so no task ever holds all rows of a key.
    """
    count = rows.groupBy(*key).agg(F.count("*").alias(f"{name}_count"))
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where(F.col("__r") <= most)
    listed = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.struct(*fields).alias("x")))), lambda v: v["x"]).alias(name))
    return count.join(listed, list(key))


def personas(messages: DataFrame, habit_patterns: Patterns = lex.HABIT_PATTERNS, fact_patterns: Patterns = lex.FACT_PATTERNS, lexicon: Mapping[str, Sequence[str]] = lex.TRAITS, cues: Mapping[str, tuple[Sequence[str], int]] = lex.EVIDENCE, tokens: Callable = word_set, most: int = LISTED) -> DataFrame:
    """One row per speaker with habits, personal_facts, personality_traits, communication_style and evidence.

    Lists hold their first `most` entries, and their counts all; details() has every entry as a row.
    """
    held = evidence(messages, cues).groupBy("speaker", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))
    mapped = held.groupBy("speaker").agg(F.map_from_entries(F.collect_list(F.struct("category", "lines"))).alias("evidence"))
    t = traits(messages, lexicon, tokens=tokens).withColumn("down", -F.col("occurrence_count"))
    s = style(messages)
    out = s.select("speaker", "message_count", F.struct(*[c for c in s.columns if c not in ("speaker", "message_count")]).alias("communication_style"))
    fields = ["category", "detail", "evidence", "confidence"]
    for part in (
        first_of(habits(messages, habit_patterns), ["speaker"], ["place"], fields, "habits", most),
        first_of(facts(messages, fact_patterns), ["speaker"], ["place"], fields, "personal_facts", most),
        first_of(t, ["speaker"], ["down", "first"], ["trait", "score", "occurrence_count", "evidence_samples"], "personality_traits", most),
        mapped,
    ):
        out = out.join(part, "speaker", "left")
    return out.withColumnRenamed("speaker", "user_id")


def facts_by_category(found: DataFrame, most: int = 3) -> DataFrame:
    """(speaker, category, details): the first details of each category, joined by '; '."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("speaker", "category").orderBy("place"))).where(F.col("rank") <= most)
    return ranked.groupBy("speaker", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "detail"))), lambda x: x["detail"]), "; ").alias("details"))


def persona_summary(people: DataFrame, most: int = 5) -> DataFrame:
    """Counts and the first entries of each list."""
    lists = ("habits", "personal_facts", "personality_traits")
    counted = lambda c: F.coalesce(f"{c}_count", F.lit(0)) if f"{c}_count" in people.columns else F.coalesce(F.size(c), F.lit(0))
    filled = [counted(c).alias(f"{c}_count") for c in lists] + [F.slice(c, 1, most).alias(f"top_{c}") for c in lists]
    return people.select("user_id", "message_count", *filled, "communication_style")


def category_lists(lexicon: Mapping[str, Sequence[str]]) -> Column:
    return F.map_from_arrays(literals(list(lexicon)), F.array(*[literals(list(w)) for w in lexicon.values()]))

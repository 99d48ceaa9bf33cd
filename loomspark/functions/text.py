"""Column functions on text: tokens, counts, flags, buckets and routers. All built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literals(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def full_text(speaker: Text, text: Text) -> Column:
    return F.concat_ws(": ", col(speaker), col(text))


def alpha_tokens(text: Text, portable: bool = False) -> Column:
    """Lower-case ASCII words of three letters or more. portable: split on non-letters first, as engines without \\b agree on."""
    low = F.lower(col(text))
    if portable:
        return F.filter(F.split(low, "[^a-z0-9_ß-ÿ]+"), lambda w: w.rlike("^[a-z]{3,}$"))
    return F.regexp_extract_all(low, F.lit(r"\b[a-zA-Z]{3,}\b"), F.lit(0))


def word_set(text: Text) -> Column:
    """Distinct Unicode word tokens of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit(r"(?U)\b\w+\b"), F.lit(0)))


def blank_tokens(text: Text) -> Column:
    """Blank-separated tokens, punctuation attached; none for the empty text."""
    return F.filter(F.split(col(text), r"\s+"), lambda w: w != "")


def without(tokens: Column, stop: Sequence[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*stop)) if stop else tokens


def contains_any(text: Text, cues: Sequence[str]) -> Column:
    """Whether the lower-cased text contains any of the cues as a substring."""
    low = F.lower(col(text))
    return reduce(Column.__or__, [low.contains(c) for c in cues], F.lit(False))


def hits(tokens: Column, words: Sequence[str]) -> Column:
    """How many distinct tokens are in the list."""
    return F.size(F.array_intersect(F.array_distinct(tokens), literals(words)))


def occurrences(text: Text, character: str) -> Column:
    return F.length(col(text)) - F.length(F.replace(col(text), F.lit(character), F.lit("")))


def pattern_count(text: Text, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern))


def shout(text: Text) -> Column:
    """All capitals and longer than three characters; digits and signs count as capitals."""
    return (F.upper(col(text)) == col(text)) & (F.length(col(text)) > 3)


def long_words(tokens: Column, over: int = 8) -> Column:
    return F.size(F.filter(tokens, lambda w: F.length(w) > over))


def all_matches(text: Text, pattern: str) -> Column:
    """Every match's group 1, or the whole match where the pattern has no group."""
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(lex.groups_in(pattern)))


def truncated(text: Text, most: int, more: str = "...") -> Column:
    return F.when(F.length(col(text)) > most, F.concat(F.left(col(text), F.lit(most)), F.lit(more))).otherwise(col(text))


def titled(text: Text) -> Column:
    return F.initcap(F.replace(col(text), F.lit("_"), F.lit(" ")))


def names(text: Text, patterns: Sequence[str] = lex.NAME_PATTERNS, blocked: Sequence[str] = lex.NAME_NOT) -> Column:
    """Distinct proper nouns, names and places longer than two characters."""
    found = F.concat(*[F.regexp_extract_all(col(text), F.lit(p), F.lit(1)) for p in patterns])
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 2) & ~F.lower(x).isin(*blocked))))


def whole_word(text: Text, entity: str) -> Column:
    """Case-insensitive whole-word occurrence of a literal."""
    return col(text).rlike(rf"(?iU)\b\Q{entity}\E\b")


def persons(text: Text, patterns: Sequence[str] = lex.PERSON_PATTERNS) -> Column:
    low = F.lower(col(text))
    return F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in patterns])


def query_words(question: str, stop: Sequence[str] = lex.RERANK_STOP_WORDS) -> list[str]:
    import re

    return sorted(set(re.findall(r"\b\w{3,}\b", question.lower())) - set(stop))


def is_persona_query(text: Text, cues: Sequence[str] = lex.PERSONA_CUES) -> Column:
    return contains_any(text, cues)


def target_user(text: Text) -> Column:
    low = F.lower(col(text))
    return F.when(low.contains("user 1") | low.contains("user1"), "User 1").when(low.contains("user 2") | low.contains("user2"), "User 2")


def aspect(text: Text, cues: Mapping[str, Sequence[str]] = lex.ASPECT_CUES) -> Column:
    """What a persona question asks for: the first aspect with a cue in it, or full."""
    return F.coalesce(*[F.when(contains_any(text, words), F.lit(name)) for name, words in cues.items()], F.lit("full"))


def entity_of(question: Text, prefer_last_about: bool = True, patterns: Sequence[str] = lex.ENTITY_PATTERNS, known: Sequence[str] = lex.ENTITY_WORDS, stop: Sequence[str] = lex.ENTITY_STOP_WORDS) -> Column:
    """The entity a question is about: patterns in order, then known words, then the last content word.

    prefer_last_about looks after the last "about" first, so that "mention anything about my sister"
    is about the sister; without it the leftmost pattern match counts.
    """
    low = F.trim(F.lower(col(question)))

    def tried(pattern: str) -> Column:
        got = F.trim(F.regexp_extract(low, pattern, 1))
        return F.when((F.length(got) > 1) & ~got.isin(*lex.ENTITY_NOT), got)

    words = F.regexp_extract_all(low, F.lit(r"(?U)\b\w+\b"), F.lit(0))
    listed = F.array_sort(F.array_intersect(F.array_distinct(words), literals(known)))
    content = F.filter(words, lambda w: ~w.isin(*stop) & (F.length(w) > 2))
    first = [tried(r"(?U)^.*\babout\s+(?:my\s+|the\s+)?(\w+)")] if prefer_last_about else []
    return F.coalesce(*first, *[tried(f"(?U){p}") for p in patterns], F.try_element_at(listed, F.lit(1)), F.try_element_at(content, F.lit(-1)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def length_style(words: Column) -> Column:
    return F.when(words < 8, "brief").when(words < 20, "moderate").otherwise("verbose")


def rate_level(rate: Column, high: float, low: float, names_: Sequence[str]) -> Column:
    return F.when(rate > high, names_[0]).when(rate > low, names_[1]).otherwise(names_[2])


def sentiment_colour(score: Column) -> Column:
    return F.when(score > 0.3, "green").when(score < -0.3, "red").otherwise("yellow")


def score_bar(score: Column, width: int = 10) -> Column:
    filled = (score * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def humanised(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(F.format_number(n / 1_000_000, 1), F.lit("M"))).when(n >= 1000, F.concat(F.format_number(n / 1000, 1), F.lit("K"))).otherwise(n.cast("string"))

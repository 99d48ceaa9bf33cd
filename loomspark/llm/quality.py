"""Quality rules: a threshold table compiled into one projection of built-in functions.

Measures (all from the whole text): words are runs of anything but ASCII blanks; word_chars are
the code points in them; n_symbols counts `#*$%&|<>`; n_dup_lines counts lines with a word that
equal an earlier line; n_repeat_words counts the words that lie in an eight-word window found twice
or more in the text. `Rule`s compare a ratio of two measures with a bound; all of them together
become one boolean column.

Defined results: null and blank texts have no words, so every count is 0, base_failed is true and
kept false. Repeated rows are judged one by one; other columns pass through, and those named like
an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, bound

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = tuple(
    "the of and to in is that for it with as was on are be this from by an or a at not have"
    " de la le les et des du un une que qui dans pour sur est en au par il elle pas"
    " der die das und den von zu mit ist im dem nicht ein eine sich auf als auch es"
    " el los las del y se por con para su al lo como más".split()
)
PUNCTUATION = "[.,;:!?]+$"


@dataclass(frozen=True)
class Rule:
    """The row passes if least <= number / per <= most."""

    name: str
    number: str
    per: str
    least: float | None = None
    most: float | None = None

    def column(self, measures: Column) -> Column:
        top, bottom = measures[self.number].cast("double"), measures[self.per].cast("double")
        checks = [top >= F.lit(self.least) * bottom] if self.least is not None else []
        checks += [top <= F.lit(self.most) * bottom] if self.most is not None else []
        return reduce(Column.__and__, checks)


#: The thresholds. Wide enough that ordinary prose of any of the languages passes.
RULES = (
    Rule("length", "n_words", "one", least=20, most=10_000_000),
    Rule("word length", "word_chars", "n_words", least=2.0, most=15.0),
    Rule("symbols", "n_symbols", "n_words", most=0.25),
    Rule("repeated words", "n_repeat_words", "n_words", most=0.30),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=0.50),
    Rule("stop words", "n_stop_words", "n_words", least=0.04),
    Rule("same word again", "n_stutters", "n_words", most=0.20),
    Rule("shouted words", "n_marks", "n_words", most=0.50),
)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_stutters")


def repeated(g: Column) -> Column:
    """Words that lie in a window whose hash stands twice or more in g, the hashes of all windows in order."""

    def positions(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.try_element_at(s, k)["g"] == x["g"], F.lit(False))
        twice = F.filter(s, lambda x, i: ((i > 0) & same(x, F.greatest(i, F.lit(1)))) | same(x, i + 2))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at(p, i + 2) - x, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda x, y: x + y)

    ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(g)) < F.size(g), bound(bound(ordered, positions), covered)).otherwise(0)


def measured(text: Column) -> Column:
    """One struct of all measures of a text. Every intermediate value is bound, so a filter on it costs no more than the struct."""

    def counts(s: Column) -> Column:
        w, lines, t, h = s["w"], s["l"], s["t"], s["h"]
        n = F.size(h) - WINDOW + 1
        windows = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))).otherwise(F.array().cast("array<long>"))
        made = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
            "n_marks": F.length(t) - F.length(F.translate(t, "!?", "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": bound(windows, repeated),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(F.regexp_replace(x, PUNCTUATION, "")).isin(*STOP_WORDS))),
            "n_stutters": F.size(F.filter(h, lambda x, i: (i > 0) & (F.try_element_at(h, F.greatest(i, F.lit(1))) == x))),
        }
        return F.struct(*[made[m].cast("long").alias(m) for m in MEASURES], F.lit(1).alias("one"))

    def hashed(s: Column) -> Column:
        return F.struct(s["w"].alias("w"), s["l"].alias("l"), s["t"].alias("t"), F.transform(s["w"], lambda x: F.xxhash64(x)).alias("h"))

    raw = F.coalesce(text, F.lit(""))
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = bound(raw, lambda t: F.struct(F.array_remove(F.split(t, SPACE), "").alias("w"), lines(t).alias("l"), t.alias("t")))
    return bound(bound(split, hashed), counts)


def judged(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One struct of the measures, base_failed and kept."""

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        kept = reduce(Column.__and__, [r.column(m) for r in rules], ~failed)
        return F.struct(*[m[x].alias(x) for x in MEASURES], failed.alias("base_failed"), F.coalesce(kept, F.lit(False)).alias("kept"))

    return bound(measured(text), verdict)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures, base_failed and kept."""
    new = (*MEASURES, "base_failed", "kept")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    told = docs.select(*rest, judged(F.col(f"`{text}`"), rules).alias("__judged"))
    return told.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[F.col("__judged")[x].alias(x) for x in new])

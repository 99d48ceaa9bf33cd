"""Sentiment scorer protocol: (text column) -> struct<compound, pos, neg>.

The default is a small own lexicon scored after the published rule: booster and negation words up to
three places ahead change a word's valence, and compound = s / sqrt(s * s + 15).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex
from .text import Text, blank_tokens, col

Scorer = Callable[[Text], Column]


def lookup(table: Mapping[str, float], word: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), word)


def lexicon_scorer(valence: Mapping[str, float] = lex.VALENCE, boosters: Mapping[str, float] = lex.BOOSTERS, negations: tuple[str, ...] | list[str] = lex.NEGATIONS) -> Scorer:
    def score(text: Text) -> Column:
        words = F.transform(blank_tokens(F.lower(col(text))), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))

        def one(w: Column, i: Column) -> Column:
            value = F.coalesce(lookup(valence, w), F.lit(0.0))
            ahead = F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
            boost = F.aggregate(ahead, F.lit(0.0), lambda a, x: a + F.coalesce(lookup(boosters, x), F.lit(0.0)))
            turned = F.when(F.exists(ahead, lambda x: x.isin(*negations)), -0.74).otherwise(1.0)
            return F.when(value == 0.0, 0.0).otherwise((value + F.signum(value) * boost) * turned)

        values = F.transform(words, one)
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        pos = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.when(x > 0, x + 1).otherwise(0.0))
        neg = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.when(x < 0, 1 - x).otherwise(0.0))
        plain = F.size(F.filter(values, lambda x: x == 0.0)).cast("double")
        mass = F.greatest(pos + neg + plain, F.lit(1e-12))
        return F.struct((total / F.sqrt(total * total + 15)).alias("compound"), (pos / mass).alias("pos"), (neg / mass).alias("neg"))

    return score

"""Appending conversations gives what building all at once gives, for every artifact."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import conflict
from loomspark.plans.corpus import KEYS, Corpus

MESSAGE = "global_index long, conversation_index long, local_index int, speaker string, text string, full_text string"
SAID = "i love cooking pasta.|my sister visits|the weather is nice|we discuss travel plans|haha that is great fun|i am so angry and sad|exam tomorrow, i am worried|i'm from a small town.|my boss said no|LOVE IT".split("|")


def conversations(spark, sizes, seed):
    rng, rows = random.Random(seed), []
    for c, size in enumerate(sizes):
        for k in range(size):
            t = " ".join(rng.choices(SAID, k=rng.randint(1, 2)))
            rows.append((len(rows), c, k, f"User {k % 2 + 1}", t, f"User {k % 2 + 1}: {t}"))
    return rows


def shown(df, drop=()):
    return sorted(str(r.asDict(True)) for r in df.drop(*drop).collect())


def test_appending_equals_building_at_once(spark, tmp_path):
    sizes = [9, 14, 3, 40, 7, 61, 5, 12, 2, 30]
    rows = conversations(spark, sizes, 3)
    one = Corpus(spark, str(tmp_path / "one")).append(spark.createDataFrame(rows, MESSAGE))
    many = Corpus(spark, str(tmp_path / "many"))
    with pytest.raises(LookupError):
        many.table("messages")
    for low, high in ((0, 4), (4, 6), (6, 10)):
        part = [r for r in rows if low <= r[1] < high]
        many = many.append(spark.createDataFrame([(r[0] - part[0][0], r[1] - low, *r[2:]) for r in part], MESSAGE))
    assert many.append(spark.createDataFrame([], MESSAGE)).now.version == 3
    for name in KEYS:
        assert shown(many.table(name)) == shown(one.table(name)), name
    again = Corpus(spark, str(tmp_path / "many"))
    assert (again.now.version, again.now.messages, again.now.conversations) == (3, len(rows), len(sizes)) and again.now.reread < len(rows) / 2
    want = conflict.mentions_of("sister", one.table("messages"))
    assert shown(again.mentions("sister")) == shown(want) and want.count() > 5
    assert one.table("topics").count() > 3 and one.table("mood_timeline").where(F.col("trigger").isNotNull()).count() > 0

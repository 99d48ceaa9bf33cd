"""Hand-made fixtures for the analytics, with values derived by hand."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.functions import text as tx
from loomspark.functions.sentiment import lexicon_scorer
from loomspark.functions.vectors import mean_pooled
from loomspark.operators import checkpoints, conflict, intent, mood, persona, retrieval, segmentation
from loomspark.plans import api
from loomspark.sources import conversations as source
from loomspark.sources import sinks
from loomspark.streaming import mood as streaming

MESSAGE = "global_index long, conversation_index long, local_index int, speaker string, text string, full_text string"


def chat(spark, texts, per=1000, speakers=("User 1", "User 2")):
    rows = [(i, i // per, i % per, speakers[i % len(speakers)], t, f"{speakers[i % len(speakers)]}: {t}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, MESSAGE)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_csv_with_multiline_cells(spark, tmp_path):
    (tmp_path / "c.csv").write_text('header,x\n"User 1: Hi ""Bo""\nUser 2: yo\nnote without speaker\nUser 1: ",1\n')
    got = source.from_csv(spark, str(tmp_path / "c.csv")).orderBy("global_index").collect()
    assert [(r.global_index, r.conversation_index, r.local_index, r.speaker, r.text) for r in got] == [(0, 0, 0, "User 1", 'Hi "Bo"'), (1, 0, 1, "User 2", "yo")]


def test_index_is_dense_over_gaps(spark):
    rows = spark.createDataFrame([(c, t, "user", "x") for c in (7, 3, 90) for t in range(c % 4 + 1)], "conv_id long, turn long, role string, text string")
    got = source.from_table(rows).orderBy("global_index").collect()
    assert [r.global_index for r in got] == list(range(len(got)))
    assert [r.conversation_index for r in got] == [0] * 4 + [1] * 4 + [2] * 3


def greedy(positions, gap):
    out = []
    for p in sorted(positions):
        if not out or p - out[-1] >= gap:
            out.append(p)
    return out


def test_gap_rule(spark):
    c = spark.createDataFrame([(x,) for x in (0, 2, 3, 4, 5, 9, 10, 11, 12, 20, 22, 23)], "at long")
    assert sorted(r.at for r in segmentation.spaced(c, "at", 3, block=8).collect()) == [0, 3, 9, 12, 20, 23]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 120), min_size=1))
def test_gap_rule_equals_the_loop(spark, positions):
    c = spark.createDataFrame([(x,) for x in positions], "at long")
    assert sorted(r.at for r in segmentation.spaced(c, "at", 3, block=16).collect()) == greedy(positions, 3)


def test_centroids_and_smoothing_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(63, 4))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "at long, v array<double>")
    sims = []
    for i in range(62):
        a, b = v[max(0, i - 4) : i + 1].mean(axis=0), v[i + 1 : i + 6].mean(axis=0)
        sims.append(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    smooth = [np.mean(sims[max(0, i - 1) : i + 2]) for i in range(62)]
    for block in (10, 4096):
        got = segmentation.smoothed(segmentation.centroid_similarity(rows, "at", "v", block=block), "at", block=block).orderBy("at").collect()
        assert np.allclose([r.sim for r in got], sims) and np.allclose([r.smoothed for r in got], smooth)


def test_smoothing_of_short_series(spark):
    s = lambda xs: [r.smoothed for r in segmentation.smoothed(spark.createDataFrame(list(enumerate(xs)), "at long, sim double"), "at").orderBy("at").collect()]
    assert np.allclose(s([1.0, 0.0, 1.0]), [0.5, 2 / 3, 0.5])
    assert s([1.0, 0.0]) == [1.0, 0.0]


def test_chunks(spark):
    m = chat(spark, ["x"] * 203)
    assert [r.message_count for r in checkpoints.checkpoints(m).orderBy("checkpoint_id").collect()] == [100, 100, 3]
    c = checkpoints.chunks(m).orderBy("chunk_id").collect()
    assert len(c) == 41 and len(c[-1].messages) == 3


def test_labels_break_ties_by_first_use(spark):
    m = chat(spark, ["bread cheese cheese bread apple"]).withColumn("topic_id", F.lit(0))
    assert segmentation.topic_labels(m).first().topic_label == "Bread & Cheese & Apple"
    m = chat(spark, ["oh yes ok"]).withColumn("topic_id", F.lit(0))
    assert segmentation.topic_labels(m).first().topic_label == "General Conversation"


def test_topics_without_words_may_be_left_out(spark):
    m = chat(spark, ["bread", "oh 1 2"]).withColumn("topic_id", F.col("global_index"))
    assert [tuple(r) for r in segmentation.topic_labels(m, without_words=None).collect()] == [(0, "Bread")]
    assert segmentation.topic_labels(m).count() == 2


def test_topics_table(spark):
    m = chat(spark, ["I love pasta with Anna Bell", "hi"]).withColumn("topic_id", F.lit(0))
    t = segmentation.topics(m).first()
    assert (t.start_msg_index, t.end_msg_index, t.message_count) == (0, 1, 2) and "I love pasta" in t.summary and "Anna Bell" in t.key_entities


def test_habits(spark):
    m = chat(spark, ["i love cooking pasta.", "i love cooking pasta.", "i'm vegan"], speakers=("User 1",))
    got = [(r.category, r.detail, r.confidence) for r in persona.habits(m).orderBy("place").collect()]
    assert got == [("food_preference", "pasta", "medium"), ("food_preference", "i love cooking", "high"), ("hobby", "i love cook", "high"), ("hobby", "cooking pasta", "high"), ("food_preference", "i'm vegan", "high")]


def test_traits(spark):
    m = chat(spark, ["love awesome awesome", "kids"], speakers=("User 1",))
    got = {r.trait: (r.occurrence_count, r.score) for r in persona.traits(m).collect()}
    assert got == {"enthusiastic": (2, 1.0), "family_oriented": (1, 1.0)}


def test_style(spark):
    m = chat(spark, ["a b c d!!!", " ".join("w" * 20)], speakers=("User 1",))
    s = persona.style(m).first()
    assert (s.avg_words, s.length_style, s.enthusiasm) == (12.0, "moderate", "moderately expressive")


def test_personas_assemble(spark):
    m = chat(spark, ["i love cooking pasta.", "i'm married and i feel happy", "hello"], speakers=("User 1",))
    p = persona.personas(m).first()
    assert p.user_id == "User 1" and len(p.habits) >= 3 and p.personal_facts and "emotional_expression" in p.evidence
    assert persona.persona_summary(persona.personas(m)).first().habits_count == len(p.habits)


def test_mood_terms(spark):
    assert one(spark, tx.shout(F.lit("NO WAY!"))) and not one(spark, tx.shout(F.lit("...")))
    m = chat(spark, ["lol!", "lol"], per=1)
    got = {r.day: r.playfulness for r in mood.mood_vectors(m).collect()}
    assert got == {0: 0.0, 1: 1.0}


def test_mood_labels_compare_sums_of_nine_digits(spark):
    """0.8 * 0.1 + 0.7 * 0.1 is 0.15000000000000002 in doubles, which isn't above 0.15."""
    day = {"formality": 1.0, "valence": 0.1, "intensity": 0.1}
    row = spark.range(1).select(*[F.lit(day.get(d, 0.0)).alias(d) for d in mood.lex.MOOD_DIMS])
    assert row.select(mood.labels()).first()[0] == ["formal", "reserved"]


def test_drift_threshold(spark):
    days = spark.createDataFrame([(0, 0.0, ["a"]), (1, 0.1, ["a"]), (2, 1.0, ["a"])], "day long, x double, mood_labels array<string>")
    got = mood.drifts(days, ["x"]).orderBy("day").collect()
    assert [r.drift_distance for r in got] == [0.0, 0.1, 0.9] and got[0].drift_threshold == 1.1 and not any(r.drift_from_prev for r in got)
    changed = mood.drifts(days.withColumn("mood_labels", F.array(F.col("day").cast("string"))), ["x"]).orderBy("day").collect()
    assert [r.drift_from_prev for r in changed] == [False, True, True]


def test_event_trigger_is_a_substring_rule(spark):
    m = chat(spark, ["she will latest"])
    assert mood.event_trigger(m).first().value == "exam"
    assert mood.event_trigger(m, word_match=True).count() == 0


def test_person_trigger(spark):
    m = chat(spark, ["my sister", "my sister and my boss"], per=1)
    days = m.select(F.col("conversation_index").alias("day"))
    got = {r.day: (r.value, len(r.evidence)) for r in mood.person_trigger(m, days).collect()}
    assert got == {0: ("sister", 1), 1: ("boss", 2)}


def test_timeline_end_to_end(spark):
    m = chat(spark, ["I love this", "great fun", "I hate this", "terrible exam", "ok", "fine"], per=2)
    t = mood.mood_timeline(m).orderBy("day").collect()
    assert [r.day for r in t] == [0, 1, 2] and not t[0].drift_from_prev
    assert all((r.trigger is not None) == r.drift_from_prev for r in t)


@pytest.mark.parametrize(("question", "fixed", "plain"), [("What did I say about my dog?", "dog", "dog"), ("Tell me about Portland", "portland", "portland"), ("Did I mention anything about my sister?", "sister", "anything about")])
def test_entity_router(spark, question, fixed, plain):
    assert one(spark, tx.entity_of(F.lit(question))) == fixed
    assert one(spark, tx.entity_of(F.lit(question), prefer_last_about=False)) == plain


def test_mention_rank(spark):
    m = spark.createDataFrame([("e", "message", 10, 10, 0.5), ("e", "message", 0, 0, 0.0)], "entity string, source string, id long, idx long, compound double")
    assert [r.rank_score for r in conflict.ranked(m).orderBy("pos").collect()] == [0.8, 0.0]


def mention_rows(spark, *rows):
    return spark.createDataFrame([("e", "message", i, t, i + 1, c) for i, (t, c) in enumerate(rows)], "entity string, source string, id long, text string, pos int, compound double")


def test_contradictions(spark):
    got = conflict.contradictions(mention_rows(spark, ("we never eat pasta tonight", 0.0), ("we eat pasta often", 0.0))).first()
    assert (got.contradiction_type, got.confidence) == ("negation", 0.7)
    got = conflict.contradictions(mention_rows(spark, ("the visit is soon", 0.0), ("it was cancelled", 0.0))).first()
    assert (got.contradiction_type, got.confidence) == ("verb", 0.8)
    got = conflict.contradictions(mention_rows(spark, ("aa", 0.8), ("bb", -0.6))).first()
    assert (got.contradiction_type, got.confidence) == ("sentiment_flip", 0.7)


def test_batch_takes_any_number_of_queries(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (300, 4)).astype(float)  # few values, so there are many ties
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vec array<float>").repartition(3)
    asked = rng.integers(-2, 3, (1500, 4)).astype(float)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "q long, vec array<float>")
    want = {(i, r + 1): (int(j), float(s[j])) for i, s in enumerate(asked @ vectors.T) for r, j in enumerate(np.lexsort((np.arange(300), -s))[:3])}
    for block in (4096, 400):
        got = retrieval.top_k_batch(index, queries, 3, "id", "q", block=block).collect()
        assert len(got) == len(want) and {(r.q, r["rank"]): (r.id, r.score) for r in got} == want


def test_batch_with_odd_vectors(spark):
    index = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan"), 0.0]), (4, [2.0, 0.0]), (5, [1.0]), (6, [2.0, 0.0])], "id long, vec array<double>").coalesce(1)
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "q string, vec array<double>")
    got = retrieval.top_k_batch(index, queries, 4, "id", "q").orderBy("q", "rank").collect()
    assert [(r.q, r.id) for r in got] == [("a", 3), ("a", 4), ("a", 6), ("a", 1), ("b", 1), ("b", 2), ("b", 3), ("b", 4)] and got[3].score is None
    assert retrieval.top_k_batch(index, queries.where("false"), 4, "id", "q").count() == 0


def test_batch_ships_blocks_once_for_each_pair_of_spans(spark):
    index = spark.range(9000).select("id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("id") * 7 + i * 3) % 101).cast("float")).alias("vec"))
    queries = index.where("id % 9 = 0").select(F.col("id").alias("q"), "vec")
    got = retrieval.top_k_batch(index, queries, 2, "id", "q", block=500)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "FlatMapCoGroupsInArrow" in plan  # no row holds a pair of blocks
    assert sorted(got.select("q", "rank", "id").collect()) == sorted(retrieval.top_k_batch(index, queries, 2, "id", "q").select("q", "rank", "id").collect()) and got.count() == 2000


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "nothing", 0.5), (2, "red house", 0.45)], "id long, text string, relevance_score double")
    got = retrieval.keyword_rerank(rows, "where is the red house", "text", "id").collect()
    assert [(r.id, round(r.relevance_score, 2)) for r in got] == [(2, 0.65), (1, 0.5)]


def test_percentiles(spark):
    got = intent.nearest_rank(spark.range(1, 101).select(F.col("id").cast("double").alias("v")), "v").first()
    assert (got.n, got.p50, got.p95, got.p99) == (100, 51.0, 96.0, 100.0)


def test_pages(spark):
    rows = spark.range(41)
    assert [retrieval.page(rows, "id", k, 20).count() for k in (1, 2, 3)] == [20, 20, 1]
    with pytest.raises(ValueError):
        retrieval.page(rows, "id", 0, 20)


def test_sentiment_signs(spark):
    score = lexicon_scorer()
    values = [one(spark, score(F.lit(t))["compound"]) for t in ("I love it", "I hate it", "not good", "very good", "good", "")]
    assert values[0] > 0 > values[1] and values[2] < 0 and values[3] > values[4] and values[5] == 0


def test_pooling():
    got = mean_pooled(np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]]))
    assert np.allclose(got, [[0.6, 0.8]])


def test_intent_accuracy_and_reject(spark, tmp_path):
    rows = intent.generated(spark, per_class=60).cache()
    assert {r.intent: r.n for r in intent.label_histogram(rows).collect()} == {k: 60 + 2 * len(v) for k, v in intent.HARD_CASES.items()}
    train, test = intent.split(rows)
    model = intent.train(train, iterations=30)
    predicted = model.predict(test).cache()
    got = {r.id: r for r in predicted.collect()}
    assert np.mean([r.intent == r.intent_pred for r in got.values()]) >= 0.9 and test.count() == len(got)
    assert model.predict(test.limit(1), reject=1.1).first().intent_pred == "unknown"
    m = intent.confusion(predicted, "intent", "intent_pred")
    assert intent.overall(intent.class_metrics(m), m).first().accuracy >= 0.9
    sinks.save_model(model, spark, str(tmp_path / "model"))
    again = sinks.load_model(spark, str(tmp_path / "model")).predict(test).collect()
    assert all((r.intent_pred, r.confidence) == (got[r.id].intent_pred, got[r.id].confidence) for r in again)
    odd = model.predict(spark.createDataFrame([("",), (None,), ("zzqqxx",)], "text string")).collect()
    assert len(odd) == 3


def test_engine(spark, tmp_path):
    words = ["i love cooking pasta", "my sister visits", "the weather is nice", "we discuss travel plans"]
    random.seed(3)
    text = "\n".join('"' + "\n".join(f"User {k % 2 + 1}: {random.choice(words)}" for k in range(8)) + '"' for _ in range(3))
    (tmp_path / "c.csv").write_text(text + "\n")
    engine = api.build(spark, str(tmp_path / "c.csv"), str(tmp_path / "out"))
    assert engine.stats()["messages"] == 24 and engine.topics()["total"] >= 1 and engine.checkpoints()["total"] == 1
    assert engine.chat("cooking pasta plans?")["answer"] and engine.persona("User 1")[0]["user_id"] == "User 1"
    assert engine.resolve("what did i say about my sister?")["entity"] == "sister" and engine.drift_summary()["total_days"] == 3
    assert engine.stats()["personas_loaded"] == ["User 1", "User 2"]
    label = engine.topics()["rows"][0]["topic_label"]
    assert engine.topics(named=label.upper())["rows"] and not engine.topics(named="zzz")["rows"]
    assert [len(v) for v in engine.suggestions().values()] == [8, 6, 6] and [len(v) for v in engine.suggestions(3).values()] == [3, 3, 3]
    with pytest.raises(LookupError):
        engine.intent_metrics()
    with pytest.raises(LookupError):
        engine.persona("User 9")
    with pytest.raises(ValueError):
        engine.chat(" ")


def test_sinks_and_absent_artifacts(spark, tmp_path):
    sinks.save(spark.range(3), str(tmp_path / "a"), json=True)
    assert spark.read.json(str(tmp_path / "a.json")).count() == 3
    assert source.artifact(spark, str(tmp_path / "none"), "x int").count() == 0
    assert sinks.as_json(spark.range(1)).first().json == '{"id":0}'


def test_intent_training_and_metrics(spark, tmp_path):
    rows = intent.generated(spark, per_class=40, hard={})
    engine = api.train_intent(spark, str(tmp_path), rows, iterations=20)
    got = engine.intent_metrics()
    assert (got["train_rows"], got["test_rows"]) == (128, 32) and sum(r["n"] for r in got["confusion"]) == 32
    assert sum(r["support"] for r in got["classes"]) == 32 and got["accuracy"] > 0.7
    shares = list(engine.intent("remind me to buy milk tomorrow")["all_probabilities"].values())
    assert len(shares) == 4 and shares == sorted(shares, reverse=True)


def test_conflict_demo_and_injected(spark, tmp_path):
    said = {"global_index": 7, "conversation_index": 1, "speaker": "User 1", "text": "my sister never calls"}
    (tmp_path / "s.json").write_text(json.dumps([{"scenario_id": "s1", "entity": "sister", "messages": [said | {"global_index": 9, "text": "she called"}, said], "topic_checkpoints": [{"topic_id": 3, "topic_label": "Sister"}]}, {"scenario_id": "s2", "entity": "boss", "messages": [said], "topic_checkpoints": []}]))
    engine = api.load_scenarios(api.Engine(spark), str(tmp_path / "s.json"))
    one, two = engine.conflict_demo()
    assert [m["global_index"] for m in one["messages"]] == [7, 9] and one["topics"][0]["topic_label"] == "Sister" and two["entity"] == "boss" and not two["topics"]
    base = chat(spark, ["a", "b"])
    both = source.with_injected(base, engine.table("scenario_messages").where("scenario_id = 's1'"))
    assert both.count() == 4 and both.columns[: len(base.columns)] == base.columns


def test_compact_mentions(spark):
    rows = spark.createDataFrame([(None, "s" * 300, None, 4), ("t", None, 8, None)], "text string, summary string, global_index long, start_msg_index long")
    got = conflict.summarised(rows).collect()
    assert [(len(r.text), r["index"], r.source, r.day_label, r.compound) for r in got] == [(200, 4, "unknown", "?", 0.0), (1, 8, "unknown", "?", 0.0)]


def test_running_sums(spark, tmp_path):
    whole = [(i % 3, f"is it good {i}?") for i in range(12)]
    (tmp_path / "in").mkdir()
    for i, part in enumerate((whole[:5], whole[5:])):
        spark.createDataFrame(part, "conversation_index long, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema("conversation_index long, text string").json(str(tmp_path / "in"))
        live = streaming.running(stream, str(tmp_path / "sums"), str(tmp_path / "checkpoint"))
        live.processAllAvailable()
        live.stop()
    got = streaming.current(spark.read.parquet(str(tmp_path / "sums")))
    want = streaming.sums(spark.createDataFrame(whole, "conversation_index long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert streaming.vectors(got).count() == 3


@pytest.mark.parametrize(("text", "detail"), [("I'm a real estate agent", "real estate"), ("i am in biotech", "in biotech"), ("I'm an apprentice", "apprentice"), ("i'm a devops lead", "devops")])
def test_occupations(spark, text, detail):
    found = {r.detail for r in persona.facts(chat(spark, [text])).where("category = 'occupation'").collect()}
    assert found == {detail}

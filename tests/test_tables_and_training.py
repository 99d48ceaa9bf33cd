"""Transcripts in many tasks, keyword tables, training by joins, personas of any size, word lists, against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.functions import lexicons as lex
from loomspark.functions import text as tx
from loomspark.functions import valence
from loomspark.operators import lexicon, linear, mood, persona
from loomspark.sources import transcripts


# transcripts


def csv_text(seed):
    rng = random.Random(seed)
    records = []
    for _ in range(rng.randint(1, 40)):
        cells = []
        for _ in range(rng.randint(1, 3)):
            body = "".join(rng.choice(["a", "User 1: hi", "\n", '""', ",", "é", "\n\n", " "]) for _ in range(rng.randint(0, 12)))
            cells.append(f'"{body}"' if rng.random() < 0.6 else rng.choice(["x", "", "plain text", '5" pipe', "y z"]))
        records.append(",".join(cells))
        if rng.random() < 0.1:
            records.append("")
    text = "\n".join(records) + rng.choice(["", "\n"])
    return text.replace("\n", "\r\n") if seed % 3 == 0 else text


@pytest.mark.parametrize("seed", range(8))
def test_records_cut_anywhere_equal_the_one_task_read(spark, tmp_path, seed):
    for i in range(2):
        (tmp_path / f"{i}.csv").write_bytes(csv_text(seed + 50 * i).encode())
    raw = spark.read.schema("_c0 string").option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", True)
    want = [r[0] for i in range(2) for r in raw.csv(f"{tmp_path}/{i}.csv").where("_c0 IS NOT NULL").collect()]
    size, open_ = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for cut in ("23", "97"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
            got = transcripts.records(spark, str(tmp_path)).select("conversation_index", transcripts.column(F.col("text")).alias("r")).where("r IS NOT NULL").orderBy("conversation_index").collect()
            assert [r.r for r in got] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", open_)


def test_quote_state_of_lines():
    for line, outside, inside in (("a", False, True), ('"a', True, False), ('a"', False, False), ('"a""', True, False), ('"a"",b"', False, False), ('5" pipe', False, False), ('x,"y', True, False), ('"', True, False), ('""', False, True), ("", False, True)):
        assert (transcripts.inside_after(line, False), transcripts.inside_after(line, True)) == (outside, inside), line
        assert transcripts.inside_after('"' + line, False) == inside


# keyword tables


def test_keyword_tables_both_ways(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["", None, "AB", "ÉA", "aa", "a"]
    texts = ["".join(rng.choice("abéÉAB ") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "ab" * 3000]
    table = spark.createDataFrame([(w, f"c{i % 7}", i % 7) for i, w in enumerate(words)], "keyword string, category string, place int")
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id int, text string, other string").repartition(4)
    want = {(i, w.lower(), k % 7) for i, t in enumerate(texts) for k, w in enumerate(words) if t and w and w.lower() in t.lower()}
    for at_most in (None, 0):
        got = [(r.id, r.keyword, r.place) for r in lexicon.contained(rows, "text", table, at_most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_rows_of_keywords_leave_in_small_batches(spark, monkeypatch):
    """A text of a kilobyte that holds 200 keywords is 200 kilobytes of rows; a task hands on HELD bytes at a time."""
    monkeypatch.setattr(lexicon, "HELD", 10_000)
    words = [f"w{i:03d}x" for i in range(200)]
    table = spark.createDataFrame([(w, "c", i) for i, w in enumerate(words)], "keyword string, category string, place int")
    rows = spark.createDataFrame([(i, " ".join(words[i:])) for i in range(20)], "id int, text string")
    got = [(r.id, r.keyword) for r in lexicon.contained(rows, "text", table).collect()]
    assert sorted(got) == [(i, w) for i in range(20) for w in words[i:]]


def test_texts_are_cut_to_the_lengths_in_use(spark):
    """Keywords of four letters or more need one gram a place."""
    table = spark.createDataFrame([("bread", "c", 0), ("milk", "c", 1)], "keyword string, category string, place int")
    found = lexicon.contained(spark.createDataFrame([(1, "no bread or milk")], "id int, text string"), "text", table, 0)
    assert sorted(r.keyword for r in found.collect()) == ["bread", "milk"]
    assert "[1,2,3,4]" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_an_automaton_of_many_keywords():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(100_000)})
    machine, text = lexicon.Automaton(words), "".join(rng.choice("abcdefgh") for _ in range(2000))
    held = {text[i : i + n] for n in range(3, 10) for i in range(len(text))}
    assert machine.found(text) == [i for i, w in enumerate(words) if w in held]


def test_first_category_is_the_event_trigger(spark):
    rng = random.Random(7)
    said = ["she will latest", "my exam", "a TRIP", "nothing", "a party, then a flight", None]
    m = spark.createDataFrame([(i, i // 6, rng.choice(said)) for i in range(90)], "global_index long, conversation_index long, text string")
    want = {(r.day, r.value, tuple(e.idx for e in r.evidence)) for r in mood.event_trigger(m).collect()}
    for at_most in (None, 0):
        got = lexicon.first_category(m.withColumnRenamed("conversation_index", "day"), "day", "global_index", "text", lexicon.table(spark, lex.EVENTS), at_most=at_most)
        assert {(r.day, r.value, tuple(e.idx for e in r.evidence)) for r in got.collect()} == want and want


# training


def test_training_by_joins_equals_plain_descent(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices(["good" if i % 3 == 0 else "bad", "plain", "word", "more", f"w{i % 5}"], k=rng.randint(0, 9))), i % 3) for i in range(60)] + [(900, "good word", None), (None, "x", 1)]
    rows = spark.createDataFrame(docs, "id long, text string, label int").repartition(4)
    tokens = F.filter(F.split("text", " "), lambda w: w != "")
    model = linear.train(rows, "id", tokens, "label", steps=4, rate=0.7, decay=0.05, max_df=0.9)
    known = [(t.split(), y) for i, t, y in docs if i is not None and y is not None]
    n, df, tf = len(known), Counter(), Counter()
    for t, _ in known:
        df.update(set(t))
        tf.update(t)
    idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in df.items() if d <= 0.9 * n}
    xs = []
    for t, _ in known:
        x = {w: (1 + math.log(k)) * idf[w] for w, k in Counter(t).items() if w in idf}
        size = math.sqrt(sum(v * v for v in x.values())) or 1.0
        xs.append({w: v / size for w, v in x.items()})
    w, b, losses = {(t, c): 0.0 for t in idf for c in range(3)}, [0.0] * 3, []
    for _ in range(5):
        ps = []
        for x in xs:
            z = [b[c] + sum(v * w[t, c] for t, v in x.items()) for c in range(3)]
            e = [math.exp(v) for v in z]
            ps.append([v / sum(e) for v in e])
        losses.append(-sum(math.log(p[y]) for p, (_, y) in zip(ps, known, strict=True)) / n)
        final = dict(w), list(b)
        g = {k: 0.05 * v for k, v in w.items()}
        for x, p, (_, y) in zip(xs, ps, known, strict=True):
            for c in range(3):
                r = (p[c] - (c == y)) / n
                b[c] -= 0.7 * r
                for t, v in x.items():
                    g[t, c] += r * v
        w = {k: v - 0.7 * g[k] for k, v in w.items()}
    assert model.losses == pytest.approx(losses, abs=1e-9) and losses[-1] < losses[0]
    got = {(r.term, r["class"]): r.w for r in model.coefficients.collect()}
    assert {k: v for k, v in got.items() if k[0]} == pytest.approx(final[0], abs=1e-9) and [got["", c] for c in range(3)] == pytest.approx(final[1], abs=1e-9)
    odd = spark.createDataFrame([(1, "good good"), (2, None), (3, "unknown"), (4, "")], "id long, text string")
    told = {r.row: r["class"] for r in model.predict(odd, "id", tokens).collect()}
    assert set(told) == {1, 2, 3, 4} and told[2] == told[3] == told[4]
    assert all(r["class"] is None for r in model.predict(odd, "id", tokens, reject=1.1).collect())


# personas and word lists


def test_personas_count_all_and_list_the_first(spark):
    m = spark.range(3000).select(F.col("id").alias("global_index"), F.lit("User 1").alias("speaker"), F.concat(F.lit("i love thing"), F.col("id").cast("string"), F.lit(". i'm from town"), (F.col("id") % 900).cast("string"), F.lit(".")).alias("text"))
    got = persona.personas(m.repartition(6), most=4).first()
    assert got.habits_count == 3000 and [h.detail for h in got.habits] == ["thing0", "thing1", "thing2", "thing3"]
    assert got.personal_facts_count == 900 and [f.detail for f in got.personal_facts] == ["town0", "town1", "town2", "town3"]
    assert persona.details(m).groupBy("kind").count().count() == 2
    summary = persona.persona_summary(persona.personas(m, most=4), 2).first()
    assert (summary.habits_count, len(summary.top_habits)) == (3000, 2)


@pytest.mark.parametrize(("question", "aspect"), [("What does User 1 eat?", "habits"), ("Do they sleep well", "habits"), ("how do they sound", "style"), ("Describe User 2", "personality"), ("who is user 1", "full"), (None, "full")])
def test_aspects(spark, question, aspect):
    assert spark.createDataFrame([(question,)], "q string").select(tx.aspect("q")).first()[0] == aspect


def test_every_emoji_range_counts(spark):
    ends = [int(x, 16) for r in lex.EMOTICON_RANGES for x in r.replace("\\x{", "").replace("}", "").split("-")]
    assert len(ends) == 16
    rows = spark.createDataFrame([(chr(c), True) for c in ends] + [("\U0001fb00", False), (":)", True), ("<3", True), ("a", False)], "t string, on boolean")
    assert rows.where((tx.pattern_count("t", lex.EMOTICONS) > 0) != F.col("on")).count() == 0


# the published valence rule

LEXICON = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "horrible": -2.5, "great": 3.1, "sux": -1.5, ":)": 2.0, ":D": 2.3, "bad": -2.5, "uncompelling": -0.9, "sure": 1.3, "bomb": -2.2, "no": -1.2, "\U0001f600": 2.0}
PUBLISHED = [
    ("VADER is smart, handsome, and funny.", 0.8316),
    ("VADER is smart, handsome, and funny!", 0.8439),
    ("VADER is very smart, handsome, and funny.", 0.8545),
    ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342),
    ("VADER is VERY SMART, uber handsome, and FRIGGIN FUNNY!!!", 0.9469),
    ("VADER is not smart, handsome, nor funny.", -0.7424),
    ("The book was good.", 0.4404),
    ("At least it isn't a horrible book.", 0.431),
    ("The book was only kind of good.", 0.3832),
    ("The plot was good, but the characters are uncompelling and the dialog is not great.", -0.7042),
    ("Today SUX!", -0.5461),
    ("Make sure you :) or :D today!", 0.8633),
    ("Not bad at all", 0.431),
]
OWN = [("", 0.0), (None, 0.0), (" \n ", 0.0), ("nothing listed", 0.0), ("ok\U0001f600", 0.4588), ("good???? ", 0.5940), ("he is the bomb", 0.6124), ("no good", -0.3412), ("least good", -0.3412), ("at least good", 0.4404), ("it is without doubt good", 0.4404), ("never so good", 0.5777)]


def test_published_sentences_have_their_scores(spark):
    texts = [*PUBLISHED, *OWN]
    rows = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(texts)], "id int, text string, pos int").repartition(3)
    table = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    boosters = {"very": 0.293, "uber": 0.293, "friggin": 0.293, "kind of": -0.293, "so": 0.293}
    got = {r.id: r for r in valence.scored(rows, "id", "text", table, boosters, ("not", "nor", "never", "isn't", "without")).collect()}
    assert {t: got[i].compound for i, (t, _) in enumerate(texts)} == {t: pytest.approx(s, abs=6e-5) for t, s in texts}
    assert all(r.pos + r.neu + r.neg == pytest.approx(1, abs=2e-3) for r in got.values() if r.compound) and got[len(PUBLISHED)].neu == 0.0


def test_valence_hands_on_tokens_of_the_lexicon_only(spark):
    rng = random.Random(9)
    said = [*LEXICON, "very", "but", "not", "least", "plain", "WORD", "'good,'", "İa!", "ΑΣ.", "so", "never"]
    texts = [" ".join(rng.choices(said, k=rng.randint(0, 30))) for _ in range(60)] + [None, "x " * 20_000 + "not good!", "GOOD " + "x " * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    table = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    got = valence.scored(rows, "id", "text", table)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert valence.met(rows.where("id >= 60"), "id", "text", table).count() == 4  # the first token of each text and one more
    joined = valence.scored(rows, "id", "text", table, at_most=0)  # tokens are shuffled to a table that is too large to broadcast
    assert sorted(joined.collect()) == sorted(got.collect())
    assert {r.id: r.compound for r in got.where("id >= 60").collect()} == {60: 0.0, 61: pytest.approx(-0.4015, abs=6e-5), 62: pytest.approx(0.5622, abs=6e-5)}  # (-0.74 * 1.9 - 0.292) and (1.9 + 0.733), each by its root


def test_rows_learned_from_are_scored_without_their_texts(spark, tmp_path):
    rows = [(i, " ".join(["good" if i % 3 else "bad", "plain", f"w{i % 4}"]), i % 2) for i in range(20)] + [(50, "", 1), (51, "unknown", None)]
    spark.createDataFrame(rows, "id long, text string, label int").write.parquet(f"{tmp_path}/texts")
    read = spark.read.parquet(f"{tmp_path}/texts")
    tokens = F.filter(F.split("text", " "), lambda w: w != "")
    model = linear.train(read, "id", tokens, "label", steps=2)
    got = {(r.row, r["class"]): r.p for r in model.fitted().collect()}
    assert not [f for f in model.fitted().inputFiles() if "/texts/" in f] and {i for i, _ in got} == {*range(20), 50}
    again = model.scores(linear.weighted(linear.counted(read, "id", tokens), model.weights), read.where("label IS NOT NULL").select(F.col("id").alias("row")))
    assert got == pytest.approx({(r.row, r["class"]): r.p for r in again.collect()}, abs=1e-12)

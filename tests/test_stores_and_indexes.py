"""Places at size, stored order, strongest contradictions, the inverted index and the vector index, against plain versions."""

from __future__ import annotations

import random
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.functions import lexicons as lex
from loomspark.operators import conflict, postings, retrieval, vector_index
from loomspark.operators.postings import Postings
from loomspark.operators.vector_index import VectorIndex
from loomspark.plans import queries
from loomspark.sources.stores import OrderedTable, places


def pruned(df, column):
    """Whether a scan of the plan reads chosen partitions of the column only."""
    return re.search(rf"PartitionFilters: \[[^\]]*{column}#", df._jdf.queryExecution().executedPlan().toString()) is not None


# places and pages


def test_places_are_dense_and_in_order_at_size(spark):
    n = 600_000
    m = spark.range(n).select(F.lit("x").alias("entity"), F.when(F.col("id") % 7 == 0, "topic").otherwise("message").alias("source"), "id", F.lit("t").alias("text"), F.lit("s").alias("speaker"), F.lit("d").alias("day_label"), F.col("id").alias("idx"), (F.col("id") % 11 / 11 - 0.4).alias("compound"))
    got = conflict.ranked(m.repartition(9)).select("source", "id", "rank_score", "pos", "day_label", "speaker").toPandas().sort_values("pos")
    assert (got["pos"].to_numpy() == np.arange(1, n + 1)).all()
    order = got.assign(down=-got["rank_score"]).sort_values(["down", "source", "id"], kind="stable")
    assert (order["pos"].to_numpy() == got["pos"].to_numpy()).all()


def test_places_of_equal_values_and_groups(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([1.0, 1.0, 2.0, -3.0]), rng.choice("ab"), i) for g in "pqr" for i in rng.sample(range(-500, 500), 120)]
    got = places(spark.createDataFrame(rows, "g string, v double, s string, id long").repartition(7), ["g"], F.col("v"), F.col("s"), ["id"], "place", block=8).collect()
    for g in "pqr":
        mine = sorted((r for r in got if r.g == g), key=lambda r: (-r.v, r.s, r.id))
        assert [r.place for r in mine] == list(range(1, 121))


def test_ordered_table(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "a", "b", "c"]), rng.randrange(50)) for i in range(1003)]
    table = OrderedTable.write(spark.createDataFrame(rows, "id long, s string, n int").repartition(5), str(tmp_path / "t"), [F.desc("n"), "id"], per_range=60)
    want = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert table.total() == 1003 and table.directory.count() > 10
    for number, size in ((1, 20), (7, 60), (51, 20), (2, 700), (1, 2000), (99, 20)):
        assert [tuple(r) for r in table.page(number, size).collect()] == want[(number - 1) * size : number * size]
    assert {(r.id, r.place) for r in table.placed().collect()} == {(r[0], i) for i, r in enumerate(want)}
    with pytest.raises(ValueError):
        table.page(0, 5)
    empty = OrderedTable.write(spark.createDataFrame([], "id long"), str(tmp_path / "e"), ["id"])
    assert empty.total() == 0 and empty.page(1, 5).count() == 0 and empty.placed().count() == 0


def test_a_deep_page_reads_one_range(spark, tmp_path):
    table = OrderedTable.write(spark.range(20_000), str(tmp_path / "t"), ["id"], per_range=1000)
    held = table.directory.orderBy("before").collect()[15]
    page = table.page(held.before // 10 + 5, 10)
    assert [r.id for r in page.collect()] == list(range((held.before // 10 + 4) * 10, (held.before // 10 + 5) * 10))
    assert pruned(page, "range") and table.rows.where(F.col("range") == held.range).count() == held.n < 3000


# strongest contradictions


def told(spark, rows):
    return conflict.ranked(spark.createDataFrame([(e, "message", i, t, "s", "d", i, c) for e, i, t, c in rows], "entity string, source string, id long, text string, speaker string, day_label string, idx long, compound double").repartition(5))


def plain_strongest(rows, most, negations, pairs):
    """Every pair looked at: (entity, place, a, b, type, confidence, detail)."""
    out = set()
    for entity in {r.entity for r in rows}:
        mine, found = sorted((r for r in rows if r.entity == entity), key=lambda r: r.pos), []
        words = [{w for w in (r.text or "").lower().split() if len(w) > 2 and w not in lex.CONTENT_STOP_WORDS} for r in mine]
        neg = [r.text is not None and bool(set(r.text.lower().split()) & set(negations)) for r in mine]
        for j, b in enumerate(mine):
            for i, a in enumerate(mine[:j]):
                tried = []
                if max(a.compound, b.compound) > 0.3 and min(a.compound, b.compound) < -0.3:
                    tried.append((-abs(round(a.compound, 9) - round(b.compound, 9)) / 2, 0, "sentiment_flip", ""))
                if neg[i] != neg[j] and len(words[i] & words[j]) > 1 and a.text is not None and b.text is not None:
                    tried.append((-0.7, 1, "negation", ", ".join(sorted(words[i] & words[j]))))
                tried += [(-0.8, 2, "verb", f"{p}/{q}") for p, q in pairs if a.text and b.text and ((p in a.text.lower() and q in b.text.lower()) or (q in a.text.lower() and p in b.text.lower()))][:1]
                if tried:
                    c, _, kind, detail = min(tried, key=lambda t: t[:2])
                    found.append((c, b.pos, a.pos, a.id, b.id, kind, detail))
        out |= {(entity, k, a, b, kind, round(-c, 3), detail) for k, (c, _, _, a, b, kind, detail) in enumerate(sorted(found)[:most], 1)}
    return out


@pytest.mark.parametrize(("seed", "feelings", "most", "first"), [(1, (0.0, 0.5, -0.5, 0.9), 10, 4096), (2, (0.0,), 6, 4), (3, (0.0, 0.1), 3, 4096), (4, None, 25, 8), (5, (0.31, -0.31, 0.3, -0.3), 1, 2)])
def test_strongest_pairs_equal_all_pairs(spark, monkeypatch, seed, feelings, most, first):
    monkeypatch.setattr(conflict, "FIRST_ROUND", first)
    rng = random.Random(seed)
    pool = "visit cancelled happy sad pasta bread river not never the and mountain weekend garden".split()
    rows = [(e, i, " ".join(rng.choices(pool, k=rng.randint(0, 6))) or None, rng.choice(feelings) if feelings else rng.uniform(-1, 1)) for e in ("x", "y") for i in range(60 if e == "x" else 15)] + [("z", 1, "alone", 0.9)]
    m = told(spark, rows)
    pairs = (("visit", "cancelled"), ("happy", "sad")) if seed != 2 else ()
    got = {(r.entity, r.place, r.a.id, r.b.id, r.contradiction_type, r.confidence, r.detail) for r in conflict.strongest(m, most, negations=("not", "never"), pairs=pairs).collect()}
    assert got == plain_strongest(m.collect(), most, ("not", "never"), pairs)


def plain_contradictions(rows, negations, pairs):
    """Every pair looked at: (entity, a, b, type, confidence, detail), feelings rounded before they are compared."""
    out = set()
    for b in rows:
        for a in (r for r in rows if r.entity == b.entity and r.pos < b.pos):
            words = [{w for w in (r.text or "").lower().split() if len(w) > 2 and w not in lex.CONTENT_STOP_WORDS} for r in (a, b)]
            neg = [bool(set((r.text or "").lower().split()) & set(negations)) for r in (a, b)]
            tried = [(-float(Decimal(repr(abs(a.compound - b.compound) / 2)).quantize(Decimal("0.001"), ROUND_HALF_UP)), 0, "sentiment_flip", "")] if max(a.compound, b.compound) > 0.3 and min(a.compound, b.compound) < -0.3 else []
            if neg[0] != neg[1] and len(words[0] & words[1]) > 1:
                tried.append((-0.7, 1, "negation", ", ".join(sorted(words[0] & words[1]))))
            x, y = ((r.text or "").lower() for r in (a, b))
            tried += [(-0.8, 2, "verb", f"{p}/{q}") for p, q in pairs if (p in x and q in y) or (q in x and p in y)][:1]
            if tried:
                c, _, kind, detail = min(tried)
                out.add((b.entity, a.id, b.id, kind, -c, detail))
    return out


@pytest.mark.parametrize(("block", "held"), [(2048, 1 << 18), (16, 40), (7, 1)])
@pytest.mark.parametrize("pairs", [(), (("visit", "cancelled"), ("happy", "sad"), ("visit", "sad"))])
def test_all_contradictions_equal_all_pairs(spark, monkeypatch, block, held, pairs):
    """One row for each contradicting pair, made in the task that looks at it: no pair is grouped, sorted or shuffled."""
    monkeypatch.setattr(conflict, "BLOCK", block)
    monkeypatch.setattr(conflict, "HELD", held)
    rng = random.Random(block)
    pool = "visit cancelled happy sad pasta bread river not never the and mountain élan straße weekend garden".split()
    feelings = (0.0, 0.3, -0.3, 0.31, -0.31, 0.699, -0.7, 0.7, 0.8, -0.799, -0.8, 0.9, -0.9)
    rows = [(e, i, " ".join(rng.choices(pool, k=rng.randint(0, 7))) or None, rng.choice(feelings)) for e in ("x", "y") for i in range(50 if e == "x" else 15)] + [("z", 1, "alone", 0.9)]
    m = told(spark, rows)
    found = conflict.contradictions(m, negations=("not", "never"), pairs=pairs)
    got = [(r.entity, r.a.id, r.b.id, r.contradiction_type, r.confidence, r.detail) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_contradictions(m.collect(), ("not", "never"), pairs)
    after = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert not any(step in after for step in ("Aggregate", "Exchange", "Join"))


def block_of(rows, first):
    """A packed block of (text, negated, feeling, sides), by place from `first`."""
    words = [sorted(set(t.split())) for t, *_ in rows]
    n = range(first, first + len(rows))
    table = pa.table({"entity": ["x"] * len(rows), "block": [0] * len(rows), "pos": list(n), "source": ["message"] * len(rows), "id": [k * 10 for k in n], "compound": [r[2] for r in rows], "neg": [r[1] for r in rows], "words": pa.array(words, pa.list_(pa.string())), "sides": pa.array([r[3] for r in rows], pa.list_(pa.bool_()))})
    return conflict.packed(table.take(pa.array(random.Random(first).sample(range(len(rows)), len(rows)))))


@pytest.mark.parametrize(("dense", "held", "negated"), [(512, 1 << 18, 0.3), (0, 1 << 18, 0.3), (3, 500, 0.3), (512, 1, 0.5), (512, 1 << 18, 0.0), (512, 1 << 18, 1.0)])
@pytest.mark.parametrize("same", [False, True])
def test_packed_blocks_cross_like_all_pairs(monkeypatch, dense, held, negated, same):
    monkeypatch.setattr(conflict, "DENSE", dense)
    monkeypatch.setattr(conflict, "HELD", held)
    rng = random.Random(dense + held)
    pool = [f"w{int(40 * rng.random() ** 3)}" for _ in range(300)] + ["élan", "straße"]
    rows = lambda n: [(" ".join(rng.choices(pool, k=rng.randint(0, 9))), rng.random() < negated, rng.choice((0.0, 0.31, -0.9, 0.9, -0.5, None)), [rng.random() < 0.2 for _ in range(4)]) for _ in range(n)]
    left = rows(70)
    right = left if same else rows(41)
    read = lambda t: conflict.Block(t["marks"][0], t["words"][0])
    a = read(block_of(left, 0))
    b = a if same else read(block_of(right, 1000))
    got = set()
    for xs, ys, kinds, strengths, details in conflict.Crossing(a, b, same, 2, 2, True).found(["one", "two"]):
        assert len(xs) <= max(held, b.n)
        got |= {(a.id[x].as_py() // 10, b.id[y].as_py() // 10, k, round(s, 3) if k == 0 else 0, d) for x, y, k, s, d in zip(xs.tolist(), ys.tolist(), kinds.tolist(), strengths.tolist(), details.to_pylist())}
    want, start = set(), 0 if same else 1000
    for x, (ta, na, ca, sa) in enumerate(left):
        for y, (tb, nb, cb, sb) in enumerate(right):
            if same and x >= y:
                continue
            ca, cb, common = ca or 0.0, cb or 0.0, sorted(set(ta.split()) & set(tb.split()))
            tried = [(-abs(ca - cb) / 2, 0, "")] if max(ca, cb) > 0.3 and min(ca, cb) < -0.3 else []
            tried += [(-0.7, 1, ", ".join(common))] if na != nb and len(common) > 1 else []
            tried += [(-0.8, 2, name) for i, name in enumerate(("one", "two")) if (sa[2 * i] and sb[2 * i + 1]) or (sa[2 * i + 1] and sb[2 * i])][:1]
            if tried:
                c, k, d = min(tried)
                want.add((x, start + y, k, round(-c, 3) if k == 0 else 0, d))
    assert got == want


def test_blocks_are_short_rows_dealt_one_at_a_time(spark):
    """A join that streams blocks holds all copies of a block at once; pairs of blocks are streamed, each takes one block."""
    rng = random.Random(3)
    texts = [" ".join(f"word{int(3000 * rng.random() ** 2)}" for _ in range(100)) for _ in range(1000)]
    row = block_of([(t, k % 5 == 0, 0.0, [False] * 4) for k, t in enumerate(texts)], 0)
    assert len(row["marks"][0].as_py()) + len(row["words"][0].as_py()) < sum(map(len, texts)) / 3
    plan = conflict.contradictions(told(spark, [("x", k, t, 0.0) for k, t in enumerate(texts[:20])]))._jdf.queryExecution().executedPlan().toString()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.split("\n")
    for n, line in enumerate(lines):
        if "BroadcastHashJoin" in line:
            below = "".join(x for x in lines[n + 1 : next((k for k in range(n + 1, len(lines)) if depth(lines[k]) <= depth(line)), len(lines))])
            assert "marks" not in below and "rows" not in below
    assert sum("SortMergeJoin" in x for x in lines) >= 3


@pytest.mark.parametrize("name", ["contradiction_verb", "contradiction_flip", "contradictions_all"])
def test_a_task_makes_only_the_columns_that_a_query_has(spark, name):
    """Names of the entity and of sources, equal in each of the many rows, are not sent from Python."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    made = re.search(r"MapInArrow [^\n]*", plan).group()
    assert "id_a" in made and not re.search(r"source_[ab]#", made)


def test_shared_words_are_listed_only_where_detail_is_asked_for(spark, monkeypatch):
    """Pairs are the same either way; the negation query counts shared words and makes no detail."""
    rng = random.Random(9)
    rows = [(" ".join(rng.choices([f"w{k}" for k in range(30)], k=8)), rng.random() < 0.4, 0.0, [False] * 2) for _ in range(200)]
    a = conflict.Block(*(block_of(rows, 0)[c][0] for c in ("marks", "words")))
    runs = {listed: [(*t, d) for x, y, _, _, detail in conflict.Crossing(a, a, True, 1, 2, listed).found(["one"]) for *t, d in zip(x.tolist(), y.tolist(), detail.to_pylist())] for listed in (True, False)}
    assert sorted(t[:2] for t in runs[True]) == sorted(t[:2] for t in runs[False]) and runs[False]
    assert all(t[2].count(",") for t in runs[True]) and not any(t[2] for t in runs[False])
    plan = queries.QUERIES["contradiction_negation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    made = re.search(r"MapInArrow [^\n]*", plan).group()
    assert "id_a" in made and not re.search(r"(source_[ab]|detail)#", made)


def test_strongest_pairs_of_an_entity_with_many_mentions(spark):
    """400,000 mentions make 8 * 10^10 pairs, a good part of them contradictions; candidates stay few."""
    n = 400_000
    m = spark.range(n).select(F.lit("x").alias("entity"), F.lit("message").alias("source"), "id", F.when(F.col("id") % 3 == 0, "we never eat pasta").otherwise("we eat pasta often").alias("text"), F.lit("s").alias("speaker"), F.lit("d").alias("day_label"), F.col("id").alias("idx"), ((F.col("id") * 7919 % 20_001) / 10_000 - 1).alias("compound"))
    got = conflict.strongest(conflict.ranked(m), 5).orderBy("place").collect()
    assert [r.confidence for r in got] == [1.0] * 5 and {r.contradiction_type for r in got} == {"sentiment_flip"}
    flat = conflict.strongest(conflict.ranked(m.withColumn("compound", F.lit(0.0))), 5).orderBy("place").collect()
    assert [(r.contradiction_type, r.confidence, r.detail) for r in flat] == [("negation", 0.7, "eat, pasta")] * 5
    assert {r.a.id for r in flat} | {r.b.id for r in flat} <= set(range(n - 40, n - 25))  # the first of those whose rank score rounds to the largest


# inverted index


TEXTS = ["My Sister's dog", "sisters are here", "SISTER!", "the san francisco bay", "San  Francisco", "san jose francisco", "very very good", "very good very", "sister-in-law", "straße STRASSE", "İstanbul ISTANBUL", None, "", "ΣΊΣΥΦΟΣ σίσυφος", "a_sister", "résister", "c++ and C#", "san francisco, san francisco"]
ASKED = ["sister", "Sister", "san francisco", "san  francisco", "very very", "very good", "sister's", "in-law", "straße", "istanbul", "σίσυφος", "nothing", "c++", "++", "francisco, san", "good"]


def test_index_names_the_texts_that_a_scan_finds(spark, tmp_path):
    rows = [(i, i % 3, 0, "User 1", t, t) for i, t in enumerate(TEXTS)]
    m = spark.createDataFrame(rows, "global_index long, conversation_index long, local_index int, speaker string, text string, full_text string")
    t = spark.createDataFrame([(1, "Sister Act", "about san", ["francisco"], 5), (2, "x", "y", None, 6), (3, "x", "y", ["San Francisco", "sister"], 7)], "topic_id int, topic_label string, summary string, key_entities array<string>, end_msg_index long")
    index = Postings(spark, str(tmp_path / "i"))
    assert index.batches == [] and index.matches("sister").count() == 0
    for texts in (postings.of_messages(m.where("global_index < 5")), postings.of_topics(t), postings.of_messages(m.where("global_index >= 5")), postings.of_messages(m.where("false"))):
        index = index.append(texts)
    assert len(index.batches) == 4
    keep = lambda df: sorted(tuple(r) for r in df.select("entity", "source", "id", "text", "day_label", "idx", "pos").collect())
    for entity in ASKED:
        assert keep(postings.mentions_by_index(entity, index, m, t)) == keep(conflict.mentions_of(entity, m, t)), entity
    assert {(r.word, r.df, r.n) for r in index.frequencies(["very", "sister", "none"]).collect()} == {("very", 2, 4), ("sister", 5, 5)}
    with pytest.raises(ValueError):
        index.matches("!?")


def test_index_reads_the_buckets_of_its_words_and_published_batches(spark, tmp_path):
    path = str(tmp_path / "i")
    rows = spark.range(300).select(F.lit("message").alias("source"), F.col("id").alias("key"), F.lit(0).alias("field"), F.concat(F.lit("word"), (F.col("id") % 40).cast("string"), F.lit(" all")).alias("text"))
    index = Postings(spark, path).append(rows)
    stray = postings.postings(rows.withColumn("key", F.col("key") + 1000)).withColumns({"bucket": postings.bucket(F.col("word")), "batch": F.lit("torn")})
    stray.write.mode("append").partitionBy("bucket", "batch").parquet(f"{path}/postings")  # an append that failed before its manifest line
    found = Postings(spark, path).matches("word7 all")
    assert sorted(r.key for r in found.collect()) == [i for i in range(300) if i % 40 == 7]
    assert pruned(found, "bucket")
    messages = spark.range(300).select(F.col("id").alias("global_index"), F.lit(0).alias("conversation_index"), F.lit("s").alias("speaker"), F.concat(F.lit("word"), (F.col("id") % 40).cast("string"), F.lit(" all")).alias("text"), F.floor(F.col("id") / postings.MESSAGES).cast("int").alias("block"))
    messages.write.partitionBy("block").parquet(f"{path}/m")
    got = postings.mentions_by_index("word7", index, spark.read.parquet(f"{path}/m"))
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString() and got.count() == 8


# vector index


def vectors(seed=5, clusters=12, each=60, dim=8):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        middle = rng.normal(size=dim) * 3
        rows += [(middle + rng.normal(size=dim) * 0.2).tolist() for _ in range(each)]
    rows += [rows[0]] * 30 + [None, [1.0] * 3, [2.0] * 3, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1e9] * dim]
    return rows


@pytest.mark.parametrize("k", [1, 7, 900])
def test_index_gives_the_scan_s_answers(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    monkeypatch.setattr(vector_index, "PART", 1)
    rows = vectors()
    e = spark.createDataFrame(list(enumerate(rows)), "id long, vec array<double>").repartition(5)
    q = e.where("id % 37 = 0 OR id > 748").withColumnRenamed("id", "q")
    index = VectorIndex.build(e, str(tmp_path / "v"), "id")
    keep = lambda df: sorted(((r.q, r["rank"], r.id, str(r.score)) for r in df.collect()))
    assert keep(index.top_k_batch(q, k, "q")) == keep(retrieval.top_k_batch(e, q, k, "id", "q"))


def test_index_reads_less_than_half_of_clustered_vectors(spark, tmp_path):
    rows = vectors()[:720]
    e = spark.createDataFrame(list(enumerate(rows)), "id long, vec array<double>")
    index = VectorIndex.build(e, str(tmp_path / "v"), "id")
    found, read = index.search(e.where("id % 10 = 0").withColumnRenamed("id", "q"), 5, "q")
    told = read.collect()
    assert len(told) == 72 and sum(r.read for r in told) < 0.5 * sum(r.lists for r in told)
    one = index.top_k(rows[100], 5)
    want = retrieval.top_k(e, rows[100], 5, "id").select("id").collect()
    assert [r.id for r in one.orderBy("rank").collect()] == [r.id for r in want]
    assert pruned(one, "list")


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, vec array<double>")
    index = VectorIndex.build(none, str(tmp_path / "v"), "id")
    assert index.top_k_batch(none.withColumnRenamed("id", "q"), 3, "q").count() == 0 and index.top_k([1.0, 2.0], 3).count() == 0

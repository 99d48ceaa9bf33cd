"""Filter audit, line deduplication and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import filter_audit, line_dedup, periodic_runs, queries

DATA = "/root/testdata/sf0.001"
ODD = [None, "", "   \n\t ", "123 456", "one", "a\tb\x0bc", "é" * 50, "x " * 3000, "dup dup", "dup dup", "A\u00a0B C\u2003D", "A" * 30, "$ 5"]


# filter audit


def plain_audit(docs, labels):
    """Rows of the audit from (id, text, part) and (id, quality, toxic), one document and one order after the other."""
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    out = defaultdict(lambda: defaultdict(int))
    for i, text, part in docs:
        t = text or ""
        w = [x for x in t.encode().split()]
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (s or "") == t for j, s, _ in docs),
        }
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = out[part or "", "".join(order), step]
                removed = fails[f] and not gone
                row["redundant"] += fails[f] and gone
                gone |= fails[f]
                row["kept"] += not gone
                row["removed"] += removed
                row["unique_fails"] += fails[f] and sum(fails.values()) == 1
                row["good_lost"] += removed and i in good
                row["toxic_lost"] += removed and i in toxic
    share = defaultdict(int)
    for (part, order, step), row in out.items():
        share[part, order[step - 1]] += row["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(k, tuple(int(r[n]) for n in names), share[k[0], k[1][k[2] - 1]]) for k, r in out.items()}


def audited(frame):
    return [((r.part, r.filter_order, r.step), (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost), r.shapley) for r in frame.collect()]


def test_audit_equals_a_plain_replay(spark):
    rng = random.Random(3)
    docs = [(i, t, p) for i, (t, p) in enumerate((t, rng.choice(["en", "de", "", None])) for t in ODD)]
    docs += [(100 + i, " ".join(rng.choice(["Ab", "c", "d%", "e", "f", str(rng.random())]) for _ in range(rng.choice([5, 250]))), "en") for i in range(12)]
    docs += [(None, "dup dup", "en"), (8, "dup dup", "de"), (None, None, None), (50, docs[20][1], "de"), (500, docs[20][1], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 30, 2), 0, 2, None, 105, 500]]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("good", "part", "A", "step", "digest", "id")}).repartition(5)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    got = audited(filter_audit.audit(rows, told))
    assert len(got) == len(set(got)) == 3 * 600 and set(got) == plain_audit(docs, labels)


def test_audit_of_empty_tables_and_other_flags(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], docs.schema)
    assert {k[1][0]: share for k, _, share in audited(filter_audit.audit(one, labels)) if k[2] == 1} == dict(zip("ABCDE", (120, 0, 0, 0, 0), strict=True))
    flags = spark.createDataFrame([("p", True, False, True, False), ("p", False, True, True, True)], "part string, x boolean, y boolean, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.replay(flags, "xy").collect()}
    assert got == {("xy", 1): (1, 1, 1, 0, 2), ("xy", 2): (0, 1, 1, 1, 2), ("yx", 1): (1, 1, 1, 1, 2), ("yx", 2): (0, 1, 1, 0, 2)}
    with pytest.raises(ValueError):
        filter_audit.replay(flags, "abcdefgh")


def test_audit_plan_broadcasts_orders_and_sums_before_the_shuffle(spark):
    plan = queries.op11_filter_audit(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "partial_count" in plan and "Python" not in plan and "CartesianProduct" not in plan


# line deduplication


def plain_lines(docs, least_chars=10, least_docs=2):
    """(n_lines, n_dropped, kept) of each (id, text)."""
    key = lambda x: bytes(x.strip(" \t\n\x0b\x0c\r"), "utf-8").lower().decode()
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders[key(x)]) < least_docs or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def line_docs(seed=11):
    rng = random.Random(seed)
    pool = [f"a common line {i}" for i in range(20)] + ["short", "", "  ", "ÀÉÎ same line ÀÉÎ", "àéî same line àéî", "İstanbul line here", "\u00a0padded with nbsp\u00a0"]
    dress = lambda x: rng.choice([x, x.upper() if x.isascii() else x, f" \t{x}\x0b", x + "\r"])
    docs = [(i, "\n".join(dress(rng.choice(pool)) if rng.random() < 0.6 else f"own line {i} {k}" for k in range(rng.randint(0, 12)))) for i in range(60)]
    return docs + [(None, "a common line 1"), (3, "a common line 1\nanother text of three"), (3, docs[3][1]), (70, None), (71, ""), (72, "\n\n"), (73, "x" * 200_000 + "\na common line 1"), (None, None)] + list(enumerate(ODD, 200))


@pytest.mark.parametrize(("chars", "least", "heavy"), [(10, 2, 10_000), (10, 2, 1), (1, 3, 4), (6, 5, 2)])
def test_lines(spark, monkeypatch, chars, least, heavy):
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    docs = line_docs()
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("n_lines", "id", "t", "gone", "h1", "row", "told", "at")}).repartition(5)
    got = line_dedup.deduplicate(rows, chars, least)
    assert set(got.columns) == {*rows.columns, "n_dropped", "kept_text"} and got.agg(F.max("gone")).first()[0] == 7
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=str)
    assert found == sorted(plain_lines(docs, chars, least), key=str)


def test_lines_of_empty_tables_and_wrong_bounds(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.deduplicate(none).count() == 0
    for wrong in ((0, 2), (10, 1)):
        with pytest.raises(ValueError):
            line_dedup.deduplicate(none, *wrong)


def test_lines_stay_in_the_jvm(spark):
    plan = queries.op12_line_dedup(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# periodic runs


def plain_runs(w, least=24):
    """All runs, by looking at every period and every stretch."""
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, 3 * q) and not any(all(w[k] == w[k + r] for k in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
            i = j
    return sorted(out, key=lambda t: (t[0], t[2]))


def periodic_texts(seed, most=200):
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randint(0, 9)):
        k, t, size = rng.choice([1, 2, 2, 3, 5]), [], rng.choice([0, 5, 30, 90, most])
        while len(t) < size:
            u = [rng.randrange(k) for _ in range(rng.randint(1, 20))]
            t += (u * rng.randint(1, 7))[: rng.randint(1, 100)] if rng.random() < 0.5 else u[:9]
        texts.append(t)
    return texts


@pytest.mark.parametrize(("few", "chunk"), [(64, 1 << 20), (1, 7)])
def test_runs_equal_all_stretches(monkeypatch, few, chunk):
    monkeypatch.setattr(periodic_runs, "FEW", few)
    monkeypatch.setattr(periodic_runs, "AT_ONCE", chunk)
    for seed in range(250):
        texts, least = periodic_texts(seed), (1, 6, 24)[seed % 3]
        got = periodic_runs.runs_of(np.array([c for t in texts for c in t], np.int32), np.array([len(t) for t in texts], np.int64), least)
        assert got == [plain_runs(t, least) for t in texts]


def test_long_runs_are_found_once():
    rng = np.random.default_rng(2)
    block = rng.integers(0, 9000, 4000)
    x = np.r_[rng.integers(0, 9000, 1000), np.tile(block, 12)[:45_000], np.zeros(30_000, np.int64), np.tile(block[:50], 100)]
    got = periodic_runs.runs_of(x, np.array([len(x)]))[0]
    assert [(n, q) for _, n, q in got if n > 100] == [(45_000, 4000), (30_000, 1), (5000, 50)] and got[0][0] == 1000


def plain_op13(i, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(i).encode()), len(w)
    g = h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k if k < a else a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed.encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_of_documents_equal_a_plain_version(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(f"w{c}" for c in t) for seed in range(40) for t in periodic_texts(seed, 150)]
    rows = list(enumerate([*ODD, *texts, "lo" * 40_000 + " ha" * 90])) + [(None, "a " * 40), (5, "b " * 30), (5, "b " * 30), (None, None)]
    rng.shuffle(rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "runs": F.lit("x")}).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((plain_op13(*r) for r in rows), key=str)


def test_runs_pass_other_columns_through(spark):
    rows = spark.createDataFrame([("k", "la " * 30, 3, "c")], "key string, collapsed string, period int, text string")
    got = periodic_runs.detect(rows, "collapsed").first()
    assert (got.key, got.text, got.n_runs, got.start, got.length, got.period, got.exponent_milli, got.collapsed) == ("k", "c", 1, 0, 30, 1, 30_000, "la")
    assert periodic_runs.detect(rows.where("false"), "text").count() == 0
    with pytest.raises(ValueError):
        periodic_runs.detect(rows, least=0)

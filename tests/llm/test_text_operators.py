"""Language ID, quality rules, PII, packing, SentencePiece and Katz scoring on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomspark.llm import katz, language_id, packing, pii, quality, sentencepiece_viterbi
from loomspark.llm.shared import remainder

DATA = "/root/testdata/sf0.001"
ODD = [None, "", "   \n\t ", "123 456", "one", "a\tb\x0bc", "é" * 50, "x " * 3000, "dup dup", "dup dup"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def odd(spark, more=()):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate([*ODD, *more])], "doc_id long, text string, score int")


# language ID


def test_language_accuracy_held_out(docs):
    model = language_id.fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    got = language_id.identify(docs, model).where(remainder(F.col("doc_id"), 5) == 0).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_code_lengths_are_exact():
    texts = {"a": ["abracadabra abra"], "b": ["zzz yyy zzz", "zyx"]}
    rows = Counter()
    for lang, ts in texts.items():
        for t in ts:
            raw = language_id.text_bytes(t)
            for k in range(language_id.ORDER + 1):
                for i in range(language_id.ORDER, len(raw)):
                    rows[k, raw[i - k : i + 1], lang] += 1
    names = sorted(texts)
    cells = [(k, int.from_bytes(g, "big"), names.index(x), n) for (k, g, x), n in rows.items()]
    model = language_id.PpmModel.from_counts(names, *[np.array(c, t) for c, t in zip(zip(*cells, strict=True), (np.int32, np.uint64, np.int64, np.int64), strict=True)])

    def bits(raw, i, lang):
        total = 0.0
        for k in range(language_id.ORDER, -1, -1):
            head = raw[i - k : i]
            follow = {g[-1]: n for (o, g, x), n in rows.items() if o == k and x == lang and g[:-1] == head}
            n, d = sum(follow.values()), len(follow)
            if raw[i] in follow:
                return total - math.log2(follow[raw[i]] / (n + d))
            total += -math.log2(d / (n + d)) if n else 0.0
        return total + 8.0

    for text in ("abra zyx q", "é", "zz" * 40):
        raw = language_id.text_bytes(text)
        want = [sum(bits(raw, i, x) for i in range(language_id.ORDER, len(raw))) for x in names]
        assert np.allclose(model.totals([raw, raw], window=16), [want, want], rtol=1e-5)


def test_language_odd_rows(spark, docs):
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(odd(spark), model).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["und"] * 4 and got[0].score == 0.0
    assert got[8].lang_pred == got[9].lang_pred and got[7].lang_pred in model.languages
    none = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(odd(spark), none).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), model).count() == 0
    assert set(docs.columns) < set(language_id.identify(docs, model).columns)


def sampled(monkeypatch, rows, **sizes):
    """Texts that fit() learns from, by language."""
    seen = []
    monkeypatch.setattr(language_id.PpmModel, "from_counts", classmethod(lambda cls, names, orders, keys, langs, counts: seen.append((names, Counter({(names[x], k): c for x, o, k, c in zip(langs, orders, keys, counts) if o == 4})))))
    language_id.fit(rows, **sizes)
    return seen[0]


def test_language_sample_of_copies(spark, monkeypatch):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = spark.createDataFrame([("a", w * 5) for w in words] + [("a", "copied text")] * 5000, "lang string, text string")
    names, grams = sampled(monkeypatch, rows, docs_per_language=160)
    # the last five bytes of "xyxyxyxyxy" tell the text apart from all others
    ends = {int.from_bytes((w * 5)[-5:].encode(), "big") for w in words}
    assert names == ["a"] and sum(("a", e) in grams for e in ends) >= 159


def test_language_of_long_texts_only(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "xyz " * 60_000), ("a", "xyz " * 60_000), ("b", "short text"), ("b", "long " * 6000)], "lang string, text string")
    names, grams = sampled(monkeypatch, rows, docs_per_language=1)
    xyz = int.from_bytes(b"xyz x", "big")
    assert names == ["a", "b"] and grams["a", xyz] == 59_999 and {x for x, _ in grams} == {"a", "b"}
    assert ("b", int.from_bytes(b"long ", "big")) not in grams


# quality rules


def plain_measures(t):
    t = t or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_measures(spark, docs):
    more = ["a b c d e f g h a b c d e f g h", "x\nx\n\n \n \nx", "a b c d e f g h " * 3 + "tail", "#*$ %&|<>"]
    rows = odd(spark, more).unionByName(docs.select("doc_id", "text", F.lit(0).alias("score")))
    for r in quality.judge(rows).collect():
        want = plain_measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_rules_keep_good_documents(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.judge(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    assert all(r.kept for r in got if r.quality == 1)
    assert quality.judge(docs.where("false")).count() == 0


def test_rules_under_a_filter(spark, docs):
    """A filter must not repeat the measures: as many sorts of arrays as the filter's own copy of the struct has."""
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (quality.judge(docs), quality.judge(docs).where("kept"))]
    assert plans[1].count("split(") <= 2 * plans[0].count("split(") and len(plans[1]) < 3 * len(plans[0])
    rows = odd(spark).unionByName(docs.select("doc_id", "text", F.lit(0).alias("score"))).withColumn("kept", F.lit("clash"))
    whole = {r.doc_id: r for r in quality.judge(rows).collect()}
    assert {r.doc_id: r for r in quality.judge(rows).where("kept").collect()} == {i: r for i, r in whole.items() if r.kept}
    assert quality.judge(docs).where("kept").select(*docs.columns).columns == docs.columns


# PII

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= len(re.sub("[^0-9]", "", t)) <= 19 and luhn(re.sub("[^0-9]", "", t))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= len(re.sub("[^0-9]", "", t)) <= 15),
)


def luhn(s):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def plain_spans(t):
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(BASE) for m in re.finditer(p, t or "") if ok(m[0])]
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(found))


PERSONAL = [
    "a@b.c_x@y.z and a@b@c.d, ..@x.y a@b. end", "1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1111x 4111111111111112",
    "call +1 (743) 555-3824, +12 or +4412345678901234567", "éé 😀 mail me: über.ann@exämple.com x@y.co 😀 9.9.9.9", "+1 4111111111111111", "9" * 5000, "a" * 20000 + "@" + "b." * 3000 + "c", "+" * 50 + "1" * 12,
]


def test_base_spans(spark, docs):
    rows = odd(spark, PERSONAL).select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    got = pii.label(rows, pii.fit(rows)).select("text", pii.listed(F.filter("pii", lambda x: x["base"])).alias("base"), "pii").collect()
    for r in got:
        assert r.base == plain_spans(r.text), r.text[:200]
        assert [(x.start, x["rank"]) for x in r.pii] == sorted((x.start, x["rank"]) for x in r.pii)


def test_added_spans_and_redaction(spark, docs):
    text = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ann@x.com 😀 end'
    rows = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string")
    model = pii.fit(rows.unionByName(docs.select("doc_id", "text")))
    got = {r.doc_id: r for r in pii.redact(pii.label(rows, model)).collect()}
    assert got[1].text == 'token = "[SECRET]" [EMAIL] 😀 end' and got[2].text == "nothing here" and got[3].text is None
    assert {x.kind for x in got[1].pii} == {"secret", "email"}
    clean = pii.label(docs, model).where(~F.col("text").rlike("[0-9@]")).where(F.size("pii") > 0)
    assert clean.count() == 0 and pii.label(docs.where("false"), model).count() == 0


def test_em_finds_the_reliable_labelers():
    rows = [("email", 1, 1, 1, 1, 0, 0, 900), ("email", 0, 0, 1, 0, 0, 0, 500), ("email", 1, 1, 0, 1, 0, 0, 300)]
    _, trust, _ = pii.em(rows, 50)
    assert trust[0][1] > 0.9 and trust[2][1] < 0.7


# packing


def test_tokens_and_packing(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = odd(spark, ["<|endoftext|> A<|STARTOFTEXT|>", "don't'S x.y…z 中文 ½", "I.̈ É.", "w " * 9000]).select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    pieces = packing.tokenize(rows, path).cache()
    by = defaultdict(list)
    for r in pieces.collect():
        by[r.doc_id].append(r)
    for r in rows.collect():
        want = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        got = sorted(by[r.doc_id], key=lambda p: p.piece)
        assert b"".join(p.ids for p in got) == want.tobytes() and all(p.length <= 4096 for p in got) and [p.start for p in got] == list(range(0, len(want), 4096))
    packed = packing.pack(pieces.select("doc_id", "piece", "start", "length"), tokens_per_packer=50_000).collect()
    filled = defaultdict(list)
    for r in packed:
        filled[r.sequence_id].append((r.offset, r.length))
    assert len(packed) == pieces.count()
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 4096
    assert packing.pack(pieces.where("false").drop("ids")).count() == 0 and packing.tokenize(rows.where("false"), path).count() == 0
    clash = packing.pack(pieces.select("doc_id", "piece", "length", F.lit("x").alias("offset"), F.lit("y").alias("sequence_id")).limit(50))
    assert dict(clash.dtypes)["offset"] == "bigint" and clash.count() == 50


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_word_cache_against_the_tokenizer(docs, most):
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = packing.WordTokens(path, most)
    texts = [*ODD, "İstanbul ǅ ﬁ Å e\u0301a", "don't we'll café, naïve!! 𝔘nicode", "<|endoftext|> <|x", *[r.text for r in docs.limit(60).collect()]]
    for at in range(0, len(texts), 7):
        for text, ids in zip(texts[at : at + 7], coder.ids(texts[at : at + 7]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == [*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_best_fit_against_a_list():
    rng = np.random.default_rng(5)
    fit, bins, opened = packing.BestFit(100, 7), {}, 0
    for n in rng.integers(1, 101, 3000).tolist():
        room = {k: f for k, f in bins.items() if f >= n}
        number, offset = fit.put(n)
        if room:
            assert bins[number] == min(room.values()) and offset == 100 - bins[number]
        else:
            assert number == opened and offset == 0
            if len(bins) == 7:
                least = min(bins.values())
                assert least not in fit.by_free or len(fit.by_free[least]) < sum(f == least for f in bins.values()) or n == 100 - least
                gone = {k for k, f in bins.items() if f == least} - {x for v in fit.by_free.values() for x in v}
                del bins[gone.pop()]
            bins[number], opened = 100, opened + 1
        bins[number] -= n
        if not bins[number]:
            del bins[number]


# SentencePiece

PIECES = "piece_bpe_32k.model"


def best_score(codec, text):
    pieces = {codec.pieces.text[i]: codec.pieces.score[i] for i, k in enumerate(codec.pieces.kind) if k in (1, 4)}
    best = [0.0] + [-math.inf] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 20), e):
            if text[s:e] in pieces:
                best[e] = max(best[e], best[s] + pieces[text[s:e]])
        if text[e - 1] not in pieces:
            best[e] = max(best[e], best[e - 1] + codec.unknown)
    return best[-1]


def test_viterbi_is_optimal_and_decodes(spark, docs):
    codec = sentencepiece_viterbi.codec(public_tokenizers.path(PIECES))
    texts = [r.text[:400] for r in docs.limit(20).collect()] + ["", "a  b", " lead", "line\nbreak\n\n", "😀\x00中 ½"]
    for text in texts:
        ids, score = codec.encode(text)
        assert codec.decode(ids) == text
        if text:
            assert score == pytest.approx(best_score(codec, sentencepiece_viterbi.MARK + text.replace(" ", sentencepiece_viterbi.MARK)), rel=1e-12)


def test_encode_columns(spark):
    path = public_tokenizers.path(PIECES)
    got = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(odd(spark), path), path).orderBy("doc_id").collect()
    assert [r.decoded for r in got] == [t or "" for t in ODD] and got[0].n_ids == 0 and got[0].score == 0.0
    assert sentencepiece_viterbi.encode(odd(spark).where("false"), path).count() == 0


def test_transcode_whole_texts(spark, docs):
    path = public_tokenizers.path(PIECES)
    codec = sentencepiece_viterbi.codec(path)
    rows = odd(spark, ["line\nbreak\n\n", "😀\x00中 ½", "word" * 9000]).unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit(0).alias("score")))
    ids = {r.doc_id: r.ids for r in sentencepiece_viterbi.encode(rows, path).collect()}
    for r in sentencepiece_viterbi.transcode(rows, path).collect():
        text = r.text or ""
        assert r.round_trip and (r.n_ids, r.ids_crc32) == (len(ids[r.doc_id]) // 4, zlib.crc32(ids[r.doc_id]))
        if text and len(text) < 3000:
            assert r.score == pytest.approx(best_score(codec, sentencepiece_viterbi.MARK + text.replace(" ", sentencepiece_viterbi.MARK)), rel=1e-9)
    assert sentencepiece_viterbi.transcode(rows.where("false"), path).count() == 0


def test_the_lookup_table_is_bounded():
    codec = sentencepiece_viterbi.Codec(sentencepiece_viterbi.Pieces.load(public_tokenizers.path(PIECES)), cache_bytes=4000)
    text = " ".join(f"word{i}" for i in range(500)) + " " + "x" * 5000
    assert codec.decode(codec.encode(text)[0]) == text and codec.held <= 4000 and len(codec.known) < 20


# Katz


def good_turing(counts, least, k=5):
    """Counts to discounted counts, written out apart from the operator."""
    n = Counter(counts)

    def of(r):
        if r > k or r < least:
            return r if r > k else 0
        c = (k + 1) * n[k + 1] / n[1] if n[1] else 0
        star = ((r + 1) * n[r + 1] / n[r]) if n[r] else r
        d = (star / r - c) / (1 - c) if c < 1 else 0
        return d * r if 0 < d < 1 else r - 0.5

    return of


def plain_katz(texts, train, least):
    toks = {i: [*(t or "").encode().lower().split(), b"\0end"] for i, t in texts.items()}
    c, pairs = Counter(), Counter()
    for i in train:
        c.update(toks[i])
        pairs.update(zip([b"\0start", *toks[i][:-1]], toks[i], strict=True))
    n, v = sum(c.values()), len(c)
    one, two = good_turing(c.values(), 1), good_turing(pairs.values(), least)
    unknown = 1 - sum(one(r) for r in c.values()) / n
    after = defaultdict(dict)
    for (h, w), r in pairs.items():
        if r >= least:
            after[h][w] = two(r)

    def p1(w):
        return one(c[w]) / n if c[w] else unknown

    def p(h, w):
        total, kept = len(train) if h == b"\0start" else c[h], sum(after[h].values())
        bottom = max(1, total + 1 if kept > total - 0.5 else total)
        if w in after[h]:
            return after[h][w] / bottom
        return (1 - kept / bottom) / (1 - sum(map(p1, after[h]))) * p1(w)

    return toks, c, n, v, p


@pytest.mark.parametrize("least", [1, 2])
def test_katz_equals_plain(spark, docs, monkeypatch, least):
    monkeypatch.setattr(katz, "BUCKET_BYTES", 1 << 16)
    texts = {r.doc_id: r.text for r in docs.collect()} | {100_000 + i: t for i, t in enumerate(ODD)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    got = {r.doc_id: r for r in katz.score(rows, remainder(F.col("doc_id"), 7) != 2, least=least).collect()}
    toks, c, n, v, p = plain_katz(texts, train, least)
    assert len(got) == len(texts)
    for i, words in toks.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(c[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words))
        if len(words) < 20_000:
            assert r.score == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip([b"\0start", *words[:-1]], words, strict=True)))
    for h in (b"\0start", b"the", b"dup"):
        assert sum(p(h, w) for w in [*c, b"\0unknown"]) == pytest.approx(1.0)
    held = [r for i, r in got.items() if i not in train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_without_training(spark):
    got = katz.score(odd(spark), F.lit(False)).collect()
    assert {r.n_known for r in got} == {0} and all(r.score == 0.0 for r in got) and katz.score(odd(spark).where("false"), F.lit(True)).count() == 0


def test_digest_is_stable():
    assert hashlib.sha256(plain_spans("x@y.z").encode()).hexdigest() == hashlib.sha256(b"email:0:5").hexdigest()

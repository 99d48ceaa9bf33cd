"""N-gram join, vector join, components, WARC and HTML extraction against plain versions."""

from __future__ import annotations

import base64
import hashlib
import importlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.llm import html_text, ngram_join, vector_join, warc
from loomspark.llm.components import components

DATA = "/root/testdata/sf0.001"


def classes(n, edges):
    root = list(range(n))
    for a, b in edges:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    out = []
    for x in range(n):
        while root[x] != x:
            x = root[x]
        out.append(x)
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components(spark, edges):
    rows = spark.createDataFrame(edges, "a long, b long") if edges else spark.createDataFrame([], "a long, b long")
    got = {r.node: r.component for r in components(rows.repartition(5)).collect()}
    want = classes(41, edges)
    assert got == {x: want[x] for a, b in edges if a != b for x in (a, b)}


def test_long_chain(spark):
    rows = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(7)
    got = components(rows).collect()
    assert len(got) == 501 and {r.component for r in got} == {0}


def plain_links(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    edges = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[j]]
    return sets, classes(len(texts), edges)


def near_copies(seed=7):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(words, 60))
    texts = [None, "", " \n", "one", "One", "a b", "a b c", "a b c d", "a b c d e"]
    for _ in range(12):
        base = list(rng.choice(words, int(rng.integers(20, 300))))
        for _ in range(int(rng.integers(1, 9))):
            t = list(base)
            for _ in range(int(rng.integers(0, max(1, len(t) // 25) + 1))):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            texts.append(" ".join(t))
    for _ in range(40):
        texts.append(" ".join(passage + list(rng.choice(words, int(rng.integers(3, 12))))))
    return texts + texts[20:30] + [" ".join(rng.choice(words, 5000))]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
@pytest.mark.parametrize("tile", [4096, 3])
def test_ngram_join(spark, monkeypatch, k, percent, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    texts = near_copies()
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n long").repartition(6)
    sets, want = plain_links(texts, k, percent)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(rows, words=k, percent=percent).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want


def test_ngram_join_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "A B C")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in ngram_join.near_duplicates(rows).collect())
    assert got == [(-1, None), (3, 3), (5, 3), (5, 3)]


def test_ngram_join_does_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(5)
    a, b = (" ".join(rng.choice([f"w{i}" for i in range(300)], 80)) for _ in range(2))
    rows = [(2, a), (2, b), (3, b + " end"), (4, a + " end"), (9, b), (2, "  ")]
    spoken = spark.createDataFrame([(a,), (b,)], "t string").orderBy(F.xxhash64("t")).first().t
    near = 4 if spoken == a else 3
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()}
        assert got == {(2, 2), (near, 2), (9, 2 if near == 3 else 3), (3, 2 if near == 3 else 3), (4, 2 if near == 4 else 4)}


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        both, a, b = (rng.integers(0, 1 << 63, int(rng.integers(1, n)), dtype=np.uint64) for n in (900, 90, 900))
        x, y = np.unique(np.r_[both, a]), np.unique(np.r_[both, b])
        assert ngram_join.differing(ngram_join.bitmap(x), ngram_join.bitmap(y)) <= len(np.setxor1d(x, y))


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.normal(size=8)
            for _ in range(int(rng.integers(1, 8))):
                rows.append((label, (base + rng.normal(size=8) * rng.choice([0.05, 0.25])).astype(np.float32).tolist()))
    rows += [rows[0], rows[0], (0, [0.0] * 8), (0, None), (0, [1.0, None] + [0.0] * 6), (1, [float("nan")] * 8), (1, [1.0, 2.0]), (1, [2.0, 4.0]), (0, [float("inf")] * 8)]
    return rows


@pytest.mark.parametrize(("block", "leaf"), [(512, 64), (8, 2)])
def test_vector_join(spark, monkeypatch, block, leaf):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("GROUP", 2), ("SPAN", 2)):
        monkeypatch.setattr(vector_join, name, value)
    rows = vectors()
    table = spark.createDataFrame([(i, v, x, 9) for i, (x, v) in enumerate(rows)], "vec_id long, embedding array<float>, label int, n_links int").repartition(4)
    sound = [x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for x, v in rows]
    links, edges = [0] * len(rows), []
    for i in range(len(rows)):
        for j in range(i):
            if sound[i] and sound[j] and rows[i][0] == rows[j][0] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[x][1], np.float32).astype(float) for x in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    edges.append((i, j))
    want = classes(len(rows), edges)
    got = {r.vec_id: r for r in vector_join.near_duplicates(table).collect()}
    assert [got[i].n_links for i in range(len(rows))] == links and len(edges) > 20
    assert [got[i].component_id for i in range(len(rows))] == want and all(got[i].kept == (want[i] == i) for i in range(len(rows)))
    assert vector_join.near_duplicates(table.where("false")).count() == 0


@pytest.mark.parametrize("scale", [1e-320, 1e-200, 1.0, 1e200, 1e308])
def test_vector_join_takes_any_magnitude(spark, scale):
    rows = [(1, [scale, 0.0]), (2, [1.0, 0.0]), (3, [-scale, scale * 0.01]), (4, [-1.0, 0.0]), (5, [0.0, 1.0]), (6, [scale, scale * 1e-3])]
    got = vector_join.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (2, 1), 2: (2, 1), 6: (2, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_vector_join_links_at_the_threshold(spark):
    """Whole numbers whose cosine is 93 / 100: about half of them fall below 0.93 when unit vectors are rounded first."""
    rng, rows = np.random.default_rng(5), []
    for label in range(40):
        turn = np.eye(8, dtype=int)
        for _ in range(2):
            v = rng.integers(1, 4, 8)
            turn = turn @ ((v @ v) * np.eye(8, dtype=int) - 2 * np.outer(v, v))
        for x in ([100, 0, 0, 0, 0, 0, 0, 0], [93, 36, 7, 2, 1, 1, 0, 0], [93, 36, 7, 2, 1, 2, 0, 0]):
            rows.append((len(rows), (turn @ np.array(x)).astype(float).tolist(), label))
    got = vector_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == {i: (1, 2, 1)[i % 3] for i in range(len(rows))}


def test_boxes_are_compared_down_a_tree(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "SPAN", 2)
    rng = np.random.default_rng(4)
    box = [(0, 2, part // 2, (part << 32) + g, [float(x), float(y)], [float(x) + 0.2, float(y) + 0.2]) for part in range(11) for g in range(3) for x, y in [rng.uniform(0, 4, 2)]]
    outline = spark.createDataFrame(box, "label long, dim int, span long, group long, low array<double>, high array<double>")
    got = {(r.ga, r.gb) for r in vector_join.group_pairs(outline, 2, 0.25, 11).collect()}
    want = {(a[3], b[3]) for a in box for b in box if a[3] <= b[3] and vector_join.boxes_apart(tuple(map(np.array, a[4:])), tuple(map(np.array, b[4:]))) ** 2 <= 0.25}
    assert got == want and len(want) < 33 * 34 / 2


PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/\r\nEvil: 1", None), (4, "u", ""), (5, "u", "é" * 2000), (6, "u", "é" * 2000), (7, "u", "tail\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>x</p>")]


@pytest.mark.parametrize(("least", "chunk"), [(0, 1 << 20), (0, 7), (100, 64)])
def test_warc_round_trip(spark, tmp_path, least, chunk):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("size", F.lit(1)).repartition(3)
    archives = warc.write(pages, str(tmp_path), least_revisit=least, chunk=chunk, archive_bytes=300)
    parts = defaultdict(dict)
    for r in warc.read(archives, chunk=chunk).collect():
        parts[r.record][r.chunk] = r
    assert archives.agg(F.sum("records")).first()[0] == len(PAGES) and len(parts) == len(PAGES)
    for page, _, body in PAGES:
        raw = (body or "").encode()
        same = [p for p, _, b in PAGES if (b or "").encode() == raw and p is not None]
        rows = [parts[page][i] for i in sorted(parts[page])]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert rows[-1].last and rows[0].size == len(raw) and rows[0].digest == digest
        if len(raw) >= least and page != max(same):
            assert (rows[0].kind, rows[0].refers) == ("revisit", max(same))
        else:
            assert (rows[0].kind, rows[0].refers, b"".join(r.data for r in rows), rows[-1].running) == ("response", None, raw, digest)


def test_warc_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(pages, str(tmp_path))).count() == 0


def page(i, article, extra=""):
    return f"""<!DOCTYPE html><html><head><title>T{i}</title><style>p{{x}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=1>Home</a><li><a href=2>News {i}</a></ul></nav><div id="cookie-notice">We use cookies</div><div class="wrap"><div class="box">{article}</div>
<div class="right"><p>Most read today on this site</p></div></div><aside>Side {i}</aside><form><input name=q>Search</form>{extra}
<div class="comments"><p>Reader {i} says hello</p></div><script>var a="</p>";</script><footer>&copy; Site</footer></body></html>"""


def test_induction_without_semantic_tags():
    articles = [f"<h2>Head {i}</h2><p>First &amp; best   story {i}<br>line two</p><p>More <b>bo</b>ld text number {i * 7}</p>" for i in range(6)]
    got = html_text.induce([page(i, a) for i, a in enumerate(articles)])
    assert got == [f"Head {i} First & best story {i} line two More bold text number {i * 7}" for i in range(6)]


def test_article_tags_and_single_pages():
    body = "<article><h1>Head</h1><p>One<p>Two<div class=ad>Buy</div><div class='share-buttons'>Share</div></article>"
    assert html_text.induce([page(1, body)]) == ["Head One Two"]
    copies = html_text.induce([page(1, body)] * 10)
    assert set(copies) == {"Head One Two"}


def test_a_notice_on_few_pages_of_a_large_host(spark):
    notice = "<div class='x'><p>Service is interrupted on Sunday</p></div>"
    rows = [(i, f"http://h/{i}", f"{notice if i % 40 == 0 else ''}<div class='y'><p>Story {i} tells of {i * 7} things</p><p>and more of {i * 3}</p></div>") for i in range(400)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Story {i} tells of {i * 7} things and more of {i * 3}" for i in range(400)}


def test_shared_text_longer_than_every_paragraph():
    legal = "<div class='z'><p>" + "All rights are reserved by the owners of this site. " * 9 + "</p></div>"
    assert html_text.induce([f"<div class='y'><p>Short story {i}</p></div>{legal}" for i in range(9)]) == [f"Short story {i}" for i in range(9)]


def test_copies_among_other_pages():
    pages = ["<div><p>One story that was copied</p></div><div class='z'><p>Shared line</p></div>"] * 20
    pages += [f"<div><p>Story number {i}</p></div><div class='z'><p>Shared line</p></div>" for i in range(9)]
    assert html_text.induce(pages) == ["One story that was copied"] * 20 + [f"Story number {i}" for i in range(9)]


def test_constant_blocks_among_like_siblings(spark):
    boxes = [f"<div><p>Notice of the day</p></div><div><p>Story {i}</p><p>goes on to {i * 7}</p></div><div><p>Write to the editor</p></div>" for i in range(9)]
    plain = [f"<p>Notice of the day</p><p>Story {i}</p><p>goes on to {i * 7}</p><p>Write to the editor</p>" for i in range(9)]
    menus = [f"<div><a>Part {i}</a> <a>Part {i + 1}</a></div><div>Story {i} goes on to {i * 7}</div>" for i in range(9)]
    want = [f"Story {i} goes on to {i * 7}" for i in range(9)]
    assert html_text.induce(boxes) == html_text.induce(plain) == html_text.induce(menus) == want
    rows = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(boxes)], "page_id long, url string, html string")
    assert [r.text for r in html_text.extract_text(rows).orderBy("page_id").collect()] == want


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://h/", "plain text"), (4, "http://h/", "<p>a<b>b</p> <!-- c -->d"), (4, "http://h/", "<p>a<b>b</p> <!-- c -->d"), (5, "http://h/", "<" * 50 + "<p title='>'>q</p>"), (6, "http://h/", "<div>" * 300 + "deep")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in html_text.extract_text(table).collect()}
    assert (got[1].text, got[1].n_chars, got[2].text, got[3].text, got[4].text) == ("", 0, "", "plain text", "ab d") and got[6].text == "deep" and got[5].text.endswith("q")
    assert html_text.extract_text(table).count() == len(rows) and html_text.extract_text(table.where("false")).count() == 0


def test_deep_and_long_pages():
    for tag in ("div", "x", "p", "ul><li", "table><tr><td"):
        assert html_text.induce([f"<{tag}>" * 100_000 + "deep <b>x</b>"]) == ["deep x"]
    deep = "".join(f"<div>t{i}" for i in range(3000)) + "".join(f"</div>u{i}" for i in range(3000))

    def blocks(node):
        for kid in node.kids:
            yield from kid.blocks if kid.sig == "#text" else blocks(kid)

    assert list(blocks(html_text.parse(deep))) == [f"t{i}" for i in range(3000)] + [f"u{i}" for i in range(3000)]
    assert html_text.induce(["<div>" * 300 + "a<nav>b<div>c</div>d</nav>e"]) == ["a e"]
    lists = ["<dl>" + "".join(f"<dt>a{i} {j}<dd>b{j} {i}" for i in range(700)) + "</dl>" for j in range(5)]
    assert html_text.induce(lists) == [" ".join(f"a{i} {j} b{j} {i}" for i in range(700)) for j in range(5)]


def test_matching_against_all_matchings():
    """Simple tree matching pairs as many nodes as the best of all order-preserving matchings."""
    rng = np.random.default_rng(4)

    def tree(depth):
        return [(str(rng.choice(list("abc"))), tree(depth - 1)) for _ in range(int(rng.integers(0, 4)))] if depth else []

    def best(xs, ys):
        if not xs or not ys:
            return 0
        (a, below_a), (b, below_b) = xs[-1], ys[-1]
        return max(best(xs[:-1], ys), best(xs, ys[:-1]), best(xs[:-1], ys[:-1]) + 1 + best(below_a, below_b) if a == b else 0)

    def slots(t):
        return [html_text.Slot(sig, slots(below)) for sig, below in t]

    def nodes(t):
        out = []
        for sig, below in t:
            node = html_text.Node(sig, sig)
            node.kids = nodes(below)
            out.append(node)
        return out

    for _ in range(60):
        x, y = tree(3), tree(3)
        left, right = slots(x), nodes(y)
        weight, pairs = html_text.matching(left, right, {})
        assert weight == best(x, y) and all(left[i].sig == right[j].sig for i, j in pairs) and pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        long = html_text.in_order(left, right)
        assert all(left[i].sig == right[j].sig for i, j in long) and all(a < c and b < d for (a, b), (c, d) in zip(long, long[1:], strict=False))


def test_the_template_decides_without_names():
    """Pages of neutral tags: with no template the constant parts between and around the paragraphs stay in the text."""
    stories = [[f"Story {i} part {k} tells of {i * 7 + k} things in {i * k + 3} places" for k in range(4)] for i in range(12)]
    pages = [f"<div><div>Part of the daily group</div><div><p>{s[0]}</p><p>Sign in to keep reading stories like this one</p><p>{s[1]}</p><div>Our readers fund us</div><p>{s[2]}</p><p>{s[3]}</p><p>Write to the desk</p></div></div>" for s in stories]
    want = [" ".join(s) for s in stories]
    plain = [html_text.extract(html_text.fold(html_text.parse(p)), {}) for p in pages]

    def f1(got):
        scores = []
        for a, b in zip(got, want, strict=True):
            x, y = a.split(), b.split()
            both = sum((Counter(x) & Counter(y)).values())
            scores.append(2 * both / (len(x) + len(y)))
        return np.mean(scores)

    assert html_text.induce(pages) == want and f1(plain) < 0.85


@pytest.mark.parametrize("per_group", [8, 64])
def test_groups_of_a_host_agree(spark, monkeypatch, per_group):
    monkeypatch.setattr(html_text, "PER_GROUP", per_group)
    rows = [(i, f"http://h/{i}", f"<div><p>Today only</p><p>Story {i} tells of {i * 7} things</p><p>and {i * 3} more</p></div><div><p>All rights reserved by us</p></div>") for i in range(200)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Story {i} tells of {i * 7} things and {i * 3} more" for i in range(200)}


def test_articles_of_the_test_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {r.page_id: " ".join(html.unescape(re.sub("<(?!/?b>)[^>]*>", " ", re.sub("</?b>", "", r.html[r.html.find("<article") : r.html.find("</article>")]))).split()) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_text.extract_text(pages).collect()} == want


def test_pipeline(spark):
    run = importlib.import_module("corpus_pipeline")
    docs, sizes = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in run.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0
    texts = [r.text for r in docs.collect()]
    assert plain_links(texts, 5, 80)[1] == list(range(len(texts)))
    packed = run.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
    row = lambda i, t: (i, t, "en", "s", 9)
    again = spark.createDataFrame([row(None, "a b c d e"), row(1, "a b c d e f g"), row(1, "a b c d e f g"), row(2, "z y x w v"), row(2, "b c d e f h")], docs.schema)
    kept = {(r.doc_id, r.text) for r in run.one_of_each(spark, again, DATA).collect()}
    assert kept == {(None, "a b c d e"), (1, "a b c d e f g"), (2, "b c d e f h")} and run.one_of_each(spark, again, DATA).count() == 3


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, blank texts, repeated rows, an extra column named like outputs, and an empty table."""
    run = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, " \n ", "en", "s", 3), (9003, "1234 5678", "en", "s", 9), (9004, "zz " * 40, "fr", "s", 120)], docs.schema)
    mixed = docs.unionByName(odd).unionByName(docs.limit(3)).withColumn("kept", F.lit("x")).withColumn("lang_pred", F.lit(7)).withColumn("component_id", F.lit("y"))
    for name, rows in (("mixed", mixed), ("none", mixed.where("false"))):
        path = str(tmp_path / name)
        rows.write.parquet(f"{path}/documents.parquet")
        out = run.run(spark, path)
        assert {"doc_id", "sequence_id", "offset"} <= set(out.columns)
        got = out.collect()
        assert (len(got) > 20) == (name == "mixed") and {r.doc_id for r in got}.isdisjoint({None, 9001, 9002, 9003, 9004})
        assert len({(r.doc_id, r.piece) for r in got}) == len(got)



@pytest.mark.parametrize("size", [1 << 20, 7])
def test_word_hashes_and_shingles(monkeypatch, size):
    monkeypatch.setattr(ngram_join, "BYTES", size)
    texts = [None, "", " ", "a", "A", "ab a\tb\x0bAB é É 😀", "x" * 50, "one two three four five", "ONE two\nthree  four", *near_copies()[9:30]]
    named = {}
    for text, h in zip(texts, ngram_join.shingled(texts, 4), strict=True):
        words = (text or "").encode().lower().split()
        plain = {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()
        assert len(h) == len(plain) and (np.diff(h.astype(object)) > 0).all()
        for t in [tuple(words[i : i + 4]) for i in range(len(words) - 3)]:
            one = next(iter(ngram_join.shingled([b" ".join(t).decode()], 4)))
            assert one[0] in h and named.setdefault(int(one[0]), t) == t

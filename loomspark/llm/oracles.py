"""DuckDB text of the queries that SQL can say."""

from __future__ import annotations

from .quality import PUNCTUATION, RULES, STOP_WORDS, SYMBOLS

WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: SHA-1 as bare base32: eight groups of five hexadecimal digits make four characters each.
BASE32 = "array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || h[(5 * (i // 4) + 1):(5 * (i // 4) + 5)])::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT]), '')"

WARC = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS last FROM p)
SELECT page_id, n AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d"""


def reached(nodes: str, links: str) -> str:
    """CTEs: least(x, c), the smallest node reachable from each node."""
    return f"r(x, y) AS (SELECT id, id FROM {nodes} UNION SELECT r.x, l.b FROM r JOIN {links} l ON r.y = l.a), least AS (SELECT x, min(y) AS c FROM r GROUP BY x)"


EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT vec_id AS id FROM embeddings), {reached("n", "l")}
SELECT id AS vec_id, (SELECT count(*) FROM l WHERE a = id) AS n_links, c AS component_id, c = id AS kept FROM n JOIN least ON x = id"""

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, {WORDS.format(FOLDED)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g FROM w),
c AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY id),
b AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY x.id, y.id),
l AS MATERIALIZED (SELECT b.a, b.b FROM b JOIN c x ON x.id = b.a JOIN c y ON y.id = b.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
n AS (SELECT id FROM w), {reached("n", "l")}
SELECT n.id AS doc_id, coalesce(c.n, 0) AS n_shingles, least.c AS component_id FROM n JOIN least ON x = n.id LEFT JOIN c ON c.id = n.id"""

VERDICT = " AND ".join(f"{r.number}::DOUBLE >= {r.least}::DOUBLE * {r.per}" for r in RULES if r.least is not None) + " AND " + " AND ".join(f"{r.number}::DOUBLE <= {r.most}::DOUBLE * {r.per}" for r in RULES if r.most is not None)
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
QUALITY = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS k FROM t WHERE len(w) >= 8),
p AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, sum(d)::BIGINT AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS d FROM p) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, length(text) - length(translate(text, '!?', '')) AS n_marks,
 len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(regexp_replace(x, '{PUNCTUATION}', '')) IN ({STOPS}))) AS n_stop_words,
 len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters, 1 AS one FROM t LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {VERDICT} AS kept FROM f"""

AUDIT = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
 coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d),
m AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, fails, len(list_filter(fails, lambda b: b)) AS n, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN m USING (doc_id)),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
r AS (SELECT x.*, p, coalesce(list_position(list_transform(p, lambda i: fails[i]), true), 6) AS first FROM x, o),
s AS (SELECT part, array_to_string(list_transform(p, lambda i: 'ABCDE'[i]), '') AS filter_order, l.i AS step, 'ABCDE'[p[l.i]] AS filter, fails[p[l.i]] AS fail, n, first, good, toxic FROM r, l),
g AS (SELECT part, filter_order, step, filter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (fail AND first < step) AS redundant,
 count(*) FILTER (fail AND n = 1) AS unique_fails, count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost FROM s GROUP BY ALL)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM g"""

LINES = r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
t AS (SELECT k.*, coalesce(n >= 2 AND doc_id <> first, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM t GROUP BY doc_id"""

ORACLE_SQL = {"op4_warc": WARC, "op5_embedding_near_dedup": EMBEDDINGS, "op7_ngram_jaccard_join": JACCARD, "op8_quality_rules": QUALITY, "op11_filter_audit": AUDIT, "op12_line_dedup": LINES}

"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id"""

_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda b: ((((strpos('0123456789abcdef', substr(h, (5 * i + b) // 4 + 1, 1)) - 1) >> CAST(3 - (5 * i + b) % 4 AS BIGINT)) & 1) << CAST(4 - b AS BIGINT)))) AS BIGINT), 1)), '')"
WARC = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p"""

_ITEM = r"list_filter(string_split_regex(" + _LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
DECONTAMINATION = rf"""WITH i AS (SELECT item_id, {_ITEM} AS w FROM benchmark), d AS (SELECT doc_id, {_ITEM} AS w FROM documents),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS k FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, runs.n, s FROM runs JOIN win ON win.n = runs.n AND win.k = runs.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

QUALITY = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g SEMI JOIN (SELECT doc_id, k FROM g GROUP BY ALL HAVING count(*) > 1) r ON r.doc_id = g.doc_id AND r.k = g.k) GROUP BY doc_id),
ln AS (SELECT doc_id, source, t, trim(regexp_replace(lower(x), '[\t-\r [:punct:]\p{{Nd}}]+', ' ', 'g')) AS k, len({_WORDS.format("x")}) AS n FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS x FROM d)),
common AS (SELECT source, k FROM ln WHERE k <> '' GROUP BY source, k HAVING count(DISTINCT t) >= 25),
lost AS (SELECT doc_id, sum(n) AS n FROM ln SEMI JOIN common ON common.source IS NOT DISTINCT FROM ln.source AND common.k = ln.k GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS gone FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - gone >= greatest(50, 0.2 * n_words) AS kept FROM j"""

LINE_DEDUP = r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS s, unnest(generate_series(1, len(l))) AS p FROM d),
f AS (SELECT doc_id, p, trim(s) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM x WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
win AS (SELECT a.doc_id, a.p AS first, coalesce(c.p, b.p, a.p) AS last, concat_ws(chr(10), a.s, b.s, c.s) AS k FROM f a LEFT JOIN f b ON b.doc_id = a.doc_id AND b.i = a.i + 1 LEFT JOIN f c ON c.doc_id = a.doc_id AND c.i = a.i + 2 WHERE a.i <= greatest(a.n - 2, 1)),
later AS (SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, first) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS p FROM later),
kept AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY p) AS text, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.l) AS n_lines, len(d.l) - coalesce(kept.n, 0) AS n_removed, coalesce(kept.text, '') AS text FROM d LEFT JOIN kept USING (doc_id)"""

"""SQL texts of the queries that SQL can express."""

PREFIX_TARGET = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
  length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<#:]', '', 'g')) + 14 AS chars FROM t),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS stop, max(k) OVER (PARTITION BY conv_id) AS last FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = last THEN stop ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id"""

LINE_FREQUENCY = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
o AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER (PARTITION BY doc_id ORDER BY i) || ' ' || lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, run FROM g WHERE run IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
v AS (SELECT doc_id, i FROM g JOIN r USING (doc_id, run)),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i FROM v UNION SELECT doc_id, i + 1 FROM v UNION SELECT doc_id, i + 2 FROM v) GROUP BY 1),
b AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
l AS (SELECT doc_id, source, trim(regexp_replace(lower(x), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM d)),
h AS (SELECT doc_id, source, md5(line) AS line, len(string_split(line, ' ')) AS words FROM l WHERE line <> ''),
m AS (SELECT doc_id, md5(string_agg(line, ',' ORDER BY line)) AS mark FROM (SELECT DISTINCT doc_id, line FROM h) GROUP BY doc_id),
q AS (SELECT source, line FROM h JOIN m USING (doc_id) GROUP BY ALL HAVING count(DISTINCT mark) > 20),
e AS (SELECT doc_id FROM h LEFT JOIN (SELECT source, line, true AS above FROM q) z USING (source, line) GROUP BY doc_id
  HAVING sum(CASE WHEN above IS NULL THEN words ELSE 0 END) < 0.2 * sum(words))
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND e.doc_id IS NULL AS kept FROM f LEFT JOIN e ON f.doc_id = e.doc_id"""

SOURCE_DIVERGENCE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_number() OVER () AS k, lang, source, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM d),
o AS (SELECT k, lang, source, unnest(terms) AS term FROM w),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, g.source, count(kept.term) AS v, coalesce(sum(kept.n), 0) AS lang_total FROM g LEFT JOIN kept USING (lang) GROUP BY 1, 2),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT v.*, coalesce(x.total, 0) AS total FROM v LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2) x USING (lang, source)),
p AS (SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n,
  CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2) // (t.total + 2 * t.v) AS HUGEINT) AS p, CAST(1 + 1000000000 * (kept.n + 2) // (t.lang_total + 2 * t.v) AS HUGEINT) AS q
  FROM t JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term) WHERE rank <= 10"""

RANKED_SEARCH = r"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) AS docs, sum(len(terms)) AS length FROM w WHERE len(terms) > 0),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM w) GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT q.item_id, q.term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM q JOIN df USING (term), s),
m AS (SELECT k, doc_id, CAST(10 + (90 * len(terms) * docs) // length AS BIGINT) AS m FROM w, s),
r AS (SELECT x.item_id, m.k, m.doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM x JOIN tf USING (term) JOIN m USING (k) GROUP BY 1, 2, 3)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
WHERE rank <= 10"""

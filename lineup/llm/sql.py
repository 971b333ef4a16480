"""The same results in plain SQL, for checking, where SQL can say them.

Windows, strings and pairs are listed outright, without hashes or prefixes.
"""

from __future__ import annotations

from .quality_rules import RULES

_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_COUNTS = ", ".join(f"sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS {name}" for name, rule in RULES.items())
_RATES = " UNION ALL ".join(f"SELECT host, n, '{name}' AS rule, {name} AS failed FROM counts" for name in RULES)

QUALITY_RULES = rf"""
WITH base AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, {_WORDS.format('text')} AS words FROM documents),
positions AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM base),
windows AS (SELECT doc_id, i, words[i:i+2] AS w FROM positions WHERE i + 2 <= len(words)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS times FROM windows) WHERE times > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 3) t(j) GROUP BY 1),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base) WHERE len({_WORDS.format('line')}) > 0),
line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY 1),
facts AS (
  SELECT b.doc_id, b.host, len(b.words)::BIGINT AS n_words, coalesce(list_sum(list_transform(b.words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(b.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n_lines, 0) AS n_lines,
         coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM base b LEFT JOIN line_counts l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
counts AS (SELECT host, count(*) AS n, {_COUNTS} FROM facts WHERE host IS NOT NULL GROUP BY 1),
rates AS ({_RATES}),
prior AS (SELECT rule, avg(failed / n) AS mean, var_pop(failed / n) AS var FROM rates GROUP BY 1),
shrunk AS (
  SELECT host, (failed + s * mean) / (n + s) AS rate FROM (
    SELECT *, least(greatest(mean * (1 - mean) / greatest(var, 1e-9) - 1, 2), 1e6) AS s FROM rates JOIN prior USING (rule))),
bad AS (SELECT host FROM shrunk GROUP BY 1 HAVING max(rate) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.host IS NULL AS kept, f.host
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts) f LEFT JOIN bad ON bad.host = f.host"""

TOPK_SEARCH = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 20"""

# The lists are replayed entry by entry: of those up to the fetch, the last day decides.
URL_FILTERS = r"""
WITH parsed AS (
  SELECT page_id, CAST(date '2022-01-01' + CAST((page_id * 7919) % 1096 AS INTEGER) AS DATE) AS fetched,
         regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
parts AS (
  SELECT page_id, fetched, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(rest, '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '[.]+$', ''), '^www[.]', '') AS host
  FROM parsed),
listed AS (
  SELECT host AS pattern, CASE WHEN ('0x' || substr(md5(host), 1, 8))::BIGINT % 2 = 0 THEN 'adult' ELSE 'gambling' END AS category
  FROM (SELECT DISTINCT host FROM parts WHERE host <> '') WHERE ('0x' || substr(md5(host), 1, 8))::BIGINT % 7 = 0
  UNION ALL SELECT DISTINCT host || path, 'takedown' FROM parts WHERE host <> '' AND page_id % 40 = 0 AND path <> ''),
coded AS (
  SELECT *, ('0x' || substr(md5(pattern), 1, 8))::BIGINT AS code,
         CAST(date '2022-01-01' + CAST(('0x' || substr(md5(pattern), 1, 8))::BIGINT % 500 AS INTEGER) AS DATE) AS first FROM listed),
entries AS (
  SELECT pattern, category, 'add' AS action, first AS day FROM coded
  UNION ALL SELECT pattern, category, 'remove', CAST(first + CAST(30 + code % 300 AS INTEGER) AS DATE) FROM coded
  UNION ALL SELECT pattern, category, CASE WHEN code % 3 = 0 THEN 'add' ELSE 'remove' END, CAST(first + CAST(400 + code % 100 AS INTEGER) AS DATE) FROM coded),
labels_of AS (SELECT page_id, fetched, host, path, string_split(host, '.') AS labels, string_split(path, '/') AS steps FROM parts WHERE host <> ''),
keys AS (
  SELECT DISTINCT page_id, fetched, pattern FROM (
    SELECT page_id, fetched, array_to_string(labels[i:], '.') AS pattern FROM labels_of, LATERAL (SELECT unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i)
    UNION ALL
    SELECT page_id, fetched, host || array_to_string(steps[1:i], '/') || CASE WHEN i < len(steps) THEN '/' ELSE '' END
    FROM labels_of, LATERAL (SELECT unnest(range(1, len(steps) + 1)) AS i) WHERE path <> '')),
active AS (
  SELECT page_id, category FROM (
    SELECT k.page_id, e.pattern, e.category, arg_max(e.action, (e.day, e.action)) AS last
    FROM keys k JOIN entries e ON e.pattern = k.pattern AND e.day <= k.fetched GROUP BY ALL) WHERE last = 'add'),
found AS (SELECT page_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM active GROUP BY 1)
SELECT p.page_id, p.host, p.fetched, coalesce(f.categories, '') AS categories, f.categories IS NOT NULL AS blocked
FROM parts p LEFT JOIN found f USING (page_id)"""

SUFFIX_DEDUP = """
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
d AS (SELECT doc_id, octet_length(b)::BIGINT AS n, hex(b) AS h FROM raw),
strings AS (SELECT doc_id, i, substr(h, (2 * i + 1)::BIGINT, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY 1),
hits AS (SELECT doc_id, i FROM strings JOIN firsts USING (s) WHERE first < doc_id),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
      SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hits)) GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT d.doc_id, coalesce(max(r.b), 0), any_value(d.n) FROM d LEFT JOIN runs r USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(d.h, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a, b) AS h FROM gaps g JOIN d USING (doc_id) GROUP BY 1),
totals AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN kept k USING (doc_id) LEFT JOIN totals t USING (doc_id)"""

NGRAM_JOIN = rf"""
WITH RECURSIVE base AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, words[i:i+4] AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM base WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM base UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.r)
SELECT b.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id FROM base b LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, piece, row_number() OVER () AS pid FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS (SELECT lang, pid, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM words),
f AS (
  SELECT lang, len, array_to_string(words[i:i + len - 1], ' ') AS phrase, count(*) AS f
  FROM places, (SELECT unnest(range(1, 5)) AS len) WHERE i + len - 1 <= len(words) GROUP BY ALL),
candidates AS (SELECT lang, phrase, len, f AS a, string_split(phrase, ' ') AS w FROM f WHERE len > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS score
  FROM (SELECT *, unnest(range(1, len)) AS k FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT c.lang, array_to_string(c.w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates c, (SELECT unnest(range(2, 4)) AS s), (SELECT unnest(range(1, 4)) AS i) WHERE s < len AND i + s - 1 <= len GROUP BY ALL),
kept AS (
  SELECT p.* FROM lowest p LEFT JOIN longer g ON g.lang = p.lang AND g.phrase = p.phrase
  WHERE g.longer IS NULL OR NOT 100 * g.longer::HUGEINT >= 80 * a::HUGEINT),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len = 1 GROUP BY 1)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN totals USING (lang)
WHERE rank <= 2000"""

_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

LEXICAL_SEARCH = f"""
WITH asked AS (SELECT item_id, {_TERMS} AS t FROM benchmark),
held AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS t FROM documents) GROUP BY 1, 2),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY 1),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
weights AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM held GROUP BY 1), totals),
scores AS (
  SELECT item_id, h.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN held h USING (t) JOIN lengths USING (doc_id) JOIN weights USING (t), totals GROUP BY 1, 2)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20"""

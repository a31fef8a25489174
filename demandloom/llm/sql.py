"""SQL twins of the text queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP6 = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents
), counted AS (
  SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    len(list_filter(w, lambda x: lower(x) IN ({{stop}}))) AS n_stop
  FROM base
), starts AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM base
), windows AS (
  SELECT r, i, w[i:i + 4] AS g FROM starts
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) AS o(k) GROUP BY r
), rates AS (
  SELECT c.*, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words,
    len(ls) AS n_lines, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
  FROM counted c LEFT JOIN covered v USING (r)
), rules AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    concat_ws(',',
      CASE WHEN n_words = 0 OR word_chars / n_words NOT BETWEEN 2.0 AND 12.0 THEN 'word_length' END,
      CASE WHEN n_words > 0 AND n_symbols / n_words > 0.1 THEN 'symbols' END,
      CASE WHEN n_words > 0 AND n_marks / n_words > 0.3 THEN 'shouting' END,
      CASE WHEN n_words >= 30 AND n_stop / n_words < 0.03 THEN 'stop_words' END,
      CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'repeated_lines' END,
      CASE WHEN n_words >= 30 AND n_lines > 0 AND n_ellipsis / n_lines > 0.3 THEN 'ellipses' END) AS broken_rules
  FROM rates
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND broken_rules = '' AS kept, broken_rules
FROM rules
"""

OP7 = r"""
WITH lines AS (
  SELECT doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, pos, line, k IN (SELECT k FROM common) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP9 = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS cap,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM docs GROUP BY source
), filled AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS stopped, sum(weight) OVER after AS open, 1.5 * sum(source_size) OVER () AS total
  FROM sources
  WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT arg_min((total - stopped) / open, cap / weight) AS level FROM filled WHERE cap >= (total - stopped) / open * weight
), plan AS (
  SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target,
    CAST('0x' || substr(md5('mix' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 5) AS BIGINT) / 1048576.0 AS u
  FROM sources, level
), placed AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN tie % 2 = 0 THEN size ELSE 1099511627776 - size END, tie, doc_id) AS nth
  FROM (SELECT *, coalesce(doc_id, 0) % 1024 AS tie FROM docs) d
), rated AS (
  SELECT p.*, s.source_size, s.target, s.u, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0.0 END AS rate
  FROM placed p JOIN plan s ON p.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target, CAST(least(floor(nth * rate + u) - floor((nth - 1) * rate + u), 2) AS BIGINT) * size AS taken
FROM rated
"""

OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) r(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
s AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
c AS (SELECT lang, phrase, m, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM s)),
v AS (SELECT c.lang, c.phrase, c.m, c.a, c.k, l.f AS l, r.f AS r, n.n, CAST((CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y JOIN n ON n.lang = c.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS rn FROM v),
q AS (SELECT lang, unnest([array_to_string(ws[1:m - 1], ' '), array_to_string(ws[2:], ' ')]) AS phrase, a FROM s WHERE m > 2),
o AS (SELECT lang, phrase, max(a) AS longer FROM q GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE rn = 1 AND (longer IS NULL OR 100 * longer < 100 * a))
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000"""

"""DuckDB texts of the queries that SQL can express, with their own copies of all limits."""

WORD = r"[^\x20\x09-\x0D]+"
# Common words of English, German, French and Spanish.
_LIST = """['a', 'al', 'als', 'and', 'are', 'as', 'at', 'au', 'auf', 'avec', 'be', 'by', 'con', 'dans', 'das', 'de',
'del', 'dem', 'den', 'der', 'des', 'die', 'du', 'ein', 'eine', 'el', 'en', 'es', 'est', 'et', 'for', 'from',
'für', 'im', 'in', 'is', 'ist', 'it', 'la', 'las', 'le', 'les', 'lo', 'los', 'mit', 'nicht', 'no', 'of', 'on',
'par', 'para', 'pas', 'por', 'pour', 'que', 'qui', 'se', 'sich', 'su', 'sur', 'that', 'the', 'this', 'to',
'un', 'una', 'und', 'une', 'von', 'was', 'with', 'y', 'zu']"""

QUALITY = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM w),
windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  length(regexp_replace(array_to_string(ws, ''), '\P{{Ll}}', '', 'g')) AS low,
  length(regexp_replace(array_to_string(ws, ''), '\P{{Lu}}', '', 'g')) AS up,
  list_transform(ws, lambda x: trim(lower(x), '.,;:!?')) AS plain
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
bins AS (
  SELECT doc_id, lang, base_failed, 'c' AS kind, v.c AS bin, v.n FROM (SELECT *, unnest([{{'c': 'low', 'n': low}}, {{'c': 'up', 'n': up}},
    {{'c': 'symbol', 'n': n_symbols}}, {{'c': 'other', 'n': word_chars - low - up - n_symbols}}]) AS v FROM b)
  UNION ALL SELECT doc_id, lang, base_failed, 'w', x, len(list_filter(plain, lambda p: p = x)) FROM b, unnest({_LIST}) AS u(x)
  UNION ALL SELECT doc_id, lang, base_failed, 'w', ' ', len(list_filter(plain, lambda p: NOT list_contains({_LIST}, p))) FROM b),
reference AS (SELECT lang, kind, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang, kind) AS q, sum(sum(n)) OVER (PARTITION BY lang, kind) AS total
  FROM bins WHERE NOT base_failed GROUP BY lang, kind, bin),
shares AS (SELECT doc_id, lang, kind, bin, n / nullif(sum(n) OVER (PARTITION BY doc_id, kind), 0) AS p FROM bins WHERE NOT base_failed),
terms AS (SELECT doc_id, s.kind, total, q,
  (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS x
  FROM shares s JOIN reference r ON s.lang IS NOT DISTINCT FROM r.lang AND s.kind = r.kind AND s.bin = r.bin),
far AS (SELECT doc_id, sum(x) FILTER (kind = 'c') AS c, sum(x) FILTER (kind = 'w') AS w,
  count(*) FILTER (kind = 'w' AND q >= 0.001) AS bins, max(total) FILTER (kind = 'w') AS total
  FROM terms GROUP BY doc_id)
SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(far.total, 0) >= 1000 AND (far.c > 0.08
    OR far.w - (far.bins - 1) / (8 * ln(2)) / n_words > 0.05 + 1.2 / n_words)) AS kept
FROM b LEFT JOIN far USING (doc_id)"""

LINES = rf"""
WITH l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS x, len(regexp_extract_all(ls[i], '{WORD}')) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)),
k AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS e, sum(n) OVER (PARTITION BY doc_id) AS total FROM l WHERE n > 0),
f AS (SELECT doc_id, pos, e, e - n AS s, total,
  list(x) OVER (PARTITION BY doc_id ORDER BY e - n RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS ahead,
  max(pos) OVER (PARTITION BY doc_id ORDER BY e - n RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS last,
  list(x) OVER (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) AS behind FROM k),
starts AS (SELECT doc_id, pos, last FROM (SELECT *, row_number() OVER (PARTITION BY ahead ORDER BY doc_id, pos) AS r
  FROM f WHERE total - s >= 50) WHERE r > 1),
ends AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY behind ORDER BY doc_id, pos) AS r
  FROM f WHERE e >= 50) WHERE r > 1),
gone AS (SELECT k.doc_id, k.pos FROM k JOIN starts s ON k.doc_id = s.doc_id AND k.pos BETWEEN s.pos AND s.last
  UNION SELECT doc_id, pos FROM ends)
SELECT d.doc_id, CASE WHEN count(gone.pos) = 0 THEN any_value(d.text)
    ELSE coalesce(string_agg(l.x, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '') END AS text,
  count(*) AS n_lines, count(gone.pos) AS n_deleted
FROM documents d JOIN l ON d.doc_id = l.doc_id LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos
GROUP BY d.doc_id"""

SQL = {"op4_divergence": QUALITY, "op5_winnowing": LINES}

"""DuckDB SQL of the corpus queries that SQL can express."""

from .line_quality import BOILERPLATE, BOILERPLATE_LINE, HEAVY, SEPARATORS, SHORT, SYMBOLS, TERMINAL


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


EXACT_DEDUP = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT DISTINCT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

_COUNT = "(length({0}) - length(regexp_replace({0}, {1}, '', 'g')))"
_TRIM = r"regexp_replace(x, '^[ \t-\r]+|[ \t-\r]+$', '', 'g')"
_NAMED = " OR ".join(f"contains(lower(x), {_text(p)})" for p in BOILERPLATE)
_FAILS = f"""(
  (regexp_matches(x, {_text(SHORT)}) AND NOT regexp_matches({_TRIM}, {_text(TERMINAL)}))
  OR ({_COUNT.format(_TRIM, _text(SEPARATORS))} >= 2 AND 4 * {_COUNT.format(_TRIM, _text(SEPARATORS))}
      >= len(regexp_extract_all({_TRIM}, '[^ \\t-\\r]+')))
  OR (length(x) <= {BOILERPLATE_LINE} AND ({_NAMED}))
  OR (length({_TRIM}) > 0 AND 10 * {_COUNT.format(_TRIM, _text(HEAVY))} > length({_TRIM})))"""

LINE_QUALITY = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w,
    string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM g, (SELECT unnest(range(0, 5)) AS k) WHERE c > 1 GROUP BY doc_id),
s AS (
  SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    {_COUNT.format('x', _text(SYMBOLS))} AS n_symbols,
    len(list_filter(lines, lambda l: regexp_matches(l, '[^ \\t-\\r]')))
      - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '[^ \\t-\\r]')))) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(regexp_extract_all(array_to_string(list_filter(lines, lambda x: NOT {_FAILS}), chr(10)), '[^ \\t-\\r]+')) AS words_left
  FROM t LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (n_words - words_left) <= 50 * n_words AS kept, words_left
FROM b
"""

HARD_NEGATIVES = """
WITH t AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.uid AS other, b.vec_id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM t a JOIN t b ON a.vec_id % 50 = 0 AND a.uid <> b.uid),
p AS (
  SELECT uid, anchor_id, other AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, other) <= 5)
SELECT p.anchor_id, positive_id,
  (row_number() OVER (PARTITION BY p.uid, positive ORDER BY score DESC, vec_id, other))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.uid = p.uid AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.uid, positive ORDER BY score DESC, vec_id, other) <= 3
"""

COLLOCATIONS = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM d),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w[i:i + m - 1] AS g FROM i, (SELECT unnest(range(1, 5)) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 30),
x AS (
  SELECT lang, g, a, k, g[1:k] AS head, g[k + 1:] AS rest
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c)),
k AS (
  SELECT x.lang, x.g, a, k, h.f AS l, r.f AS r, (2000000::HUGEINT * a) // (h.f + r.f) AS score
  FROM x JOIN f h ON h.lang = x.lang AND h.g = x.head JOIN f r ON r.lang = x.lang AND r.g = x.rest),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
s AS (
  SELECT lang, sub, max(a) AS above FROM (
    SELECT lang, a, g[j:j + m - 1] AS sub
    FROM c, (SELECT unnest(range(2, 4)) AS m), (SELECT unnest(range(1, 4)) AS j) WHERE m < len(g) AND j + m - 1 <= len(g))
  GROUP BY lang, sub),
r AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
  FROM b JOIN n ON n.lang = b.lang LEFT JOIN s ON s.lang = b.lang AND s.sub = b.g
  WHERE above IS NULL OR 100 * above < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM r QUALIFY rank <= 2000
"""

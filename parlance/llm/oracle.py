"""DuckDB SQL for the corpus queries that SQL can express."""

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"[^ \t\n\x0B\f\r]+"
NORMALISED = (
    rf"translate(regexp_replace(trim(line, {SPACES}), '[ \t\n\x0B\f\r]+', ' ', 'g'),"
    " 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
BARE_CHARS = "length(translate(coalesce({0}, ''), " + SPACES + ", ''))"

ORACLE: dict[str, str] = {}

ORACLE["op8_quality_rules"] = rf"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, source, text, coalesce(text, '') AS t
  FROM documents
), words AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
  FROM (SELECT r, regexp_extract_all(t, '{WORD}') AS ws FROM docs)
), threes AS (
  SELECT r, pos, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS three
  FROM words WINDOW p AS (PARTITION BY r ORDER BY pos)
), places AS (
  SELECT r, pos FROM (
    SELECT r, pos, three, count(*) OVER (PARTITION BY r, three) AS n FROM threes WHERE three IS NOT NULL
  ) WHERE n > 1
), covered AS (
  SELECT r, sum(least(3, coalesce(nxt - pos, 3))) AS n_repeat_words
  FROM (SELECT r, pos, lead(pos) OVER (PARTITION BY r ORDER BY pos) AS nxt FROM places) GROUP BY r
), lines AS (
  SELECT r, doc_id, source, text, line, {NORMALISED} AS norm
  FROM (SELECT r, doc_id, source, text, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE trim(line, {SPACES}) <> ''
), line_texts AS (
  SELECT source, norm, count(DISTINCT text) AS n FROM lines GROUP BY source, norm
), host_texts AS (
  SELECT source, count(DISTINCT text) + max((text IS NULL)::int) AS n FROM docs GROUP BY source
), frequent AS (
  SELECT l.source, l.norm FROM line_texts l JOIN host_texts h ON l.source IS NOT DISTINCT FROM h.source
  WHERE l.n > 10 AND (100 * l.n > 2 * h.n OR l.n > 100)
), per_doc AS (
  SELECT l.r, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(f.norm) AS n_frequent_lines,
    sum(CASE WHEN f.norm IS NOT NULL THEN {BARE_CHARS.format("line")} ELSE 0 END) AS gone,
    sum(CASE WHEN f.norm IS NOT NULL THEN len(regexp_extract_all(line, '{WORD}')) ELSE 0 END) AS gone_words
  FROM lines l LEFT JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm
  GROUP BY l.r
), signals AS (
  SELECT d.r, d.doc_id, len(regexp_extract_all(t, '{WORD}')) AS n_words,
    {BARE_CHARS.format("t")} AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    coalesce(p.n_dup_lines, 0) AS n_dup_lines,
    coalesce(c.n_repeat_words, 0) AS n_repeat_words,
    coalesce(p.n_frequent_lines, 0) AS n_frequent_lines,
    coalesce(p.gone, 0) AS gone, coalesce(p.gone_words, 0) AS gone_words
  FROM docs d LEFT JOIN covered c USING (r) LEFT JOIN per_doc p ON d.r = p.r
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
  n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  n_frequent_lines::BIGINT AS n_frequent_lines, (n_words - gone_words)::BIGINT AS n_left_words,
  (word_chars - gone)::BIGINT AS n_left_chars,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - gone_words >= 50
    AND 100 * (word_chars - gone) >= 50 * word_chars AS kept
FROM signals
"""

ORACLE["op9_line_dedup"] = rf"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, source, text FROM documents
), parts AS (
  SELECT r, doc_id, source, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM docs WHERE text IS NOT NULL)
), lines AS (
  SELECT *, trim(line, {SPACES}) <> '' AS worded, {NORMALISED} AS norm FROM parts
), spread AS (
  SELECT norm FROM lines WHERE worded GROUP BY norm
  HAVING count(DISTINCT source) >= 10 AND count(DISTINCT text) FILTER (source IS NOT NULL) >= 10
), marked AS (
  SELECT l.*, l.worded AND s.norm IS NOT NULL AS hit FROM lines l LEFT JOIN spread s USING (norm)
), judged AS (
  SELECT r, count(*) FILTER (worded) AS n_lines, count(*) FILTER (hit) AS hits,
    string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit) AS rest
  FROM marked GROUP BY r
), left_texts AS (
  SELECT d.doc_id, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.hits, 0) AS n_removed,
    CASE WHEN hits > 0 THEN coalesce(rest, '') ELSE d.text END AS left_text
  FROM docs d LEFT JOIN judged j USING (r)
)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed,
  length(left_text)::BIGINT AS n_chars, sha256(left_text) AS left_sha256
FROM left_texts
"""

ORACLE["op10_substring_dedup"] = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM docs
), windows AS (
  SELECT doc_id, pos, sha256(array_to_string(ws[pos:pos + 49], ' ')) AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS pos FROM docs WHERE len(ws) >= 50)
), earliest AS (
  SELECT win, min(doc_id) AS first FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)
), starts AS (
  SELECT doc_id, pos FROM windows JOIN earliest USING (win) WHERE doc_id > first
), marked AS (
  SELECT w.doc_id, w.pos, w.w, max(s.pos) OVER (
    PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words w LEFT JOIN starts s ON w.doc_id = s.doc_id AND w.pos = s.pos
), per_doc AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""

ORACLE["op5_minmax_near_dedup"] = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents
), shingles AS (
  SELECT doc_id, len(ws) AS n, unnest(list_distinct(
    CASE WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS s
  FROM docs WHERE len(ws) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND (a.n < 4) = (b.n < 4) AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, root) AS (
  SELECT doc_id, doc_id FROM docs
  UNION
  SELECT edges.b, reached.root FROM reached JOIN edges ON edges.a = reached.doc_id WHERE reached.root < edges.b
), classes AS (
  SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM docs d LEFT JOIN sizes s USING (doc_id) JOIN classes c USING (doc_id)
"""


def _rounds(rounds: int) -> str:
    """Assignment to the nearest entry and new entries, round by round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
nearest{r} AS MATERIALIZED (
  SELECT r, label, p, v, min(d) AS d, arg_min(e, (d, e)) AS e FROM (
    SELECT r, label, parts.p, v, e, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) ** 2))::BIGINT AS d
    FROM parts JOIN book{r} USING (p)
  ) GROUP BY r, label, p, v
)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
    SELECT p, e, i, sum(v[i])::DOUBLE AS s, count(*)::DOUBLE AS n
    FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM nearest{r}) GROUP BY p, e, i
  ) GROUP BY p, e
), book{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(sums{r}.c, book{r}.c) AS c FROM book{r} LEFT JOIN sums{r} USING (p, e)
)""")
    return ",".join(steps)


ORACLE["op12_grid_cell_codes"] = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, ints) AS r, vec_id, label, ints FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS ints
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  )
), parts AS MATERIALIZED (
  SELECT r, label, p, ints[p * len(ints) // 8 + 1 : (p + 1) * len(ints) // 8] AS v FROM kept, range(8) AS t(p)
), book0 AS MATERIALIZED (
  SELECT p, r - 1 AS e, v AS c FROM parts WHERE r <= 16
),{_rounds(6)}, coded AS (
  SELECT r, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM nearest6 GROUP BY r, label
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book6
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY coded.label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), digest
"""

"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN array_to_string(ws[i:i + 34], ' ') END AS seq
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
twice AS (SELECT seq FROM p WHERE seq IS NOT NULL GROUP BY seq HAVING count(*) > 1),
hit AS (SELECT p.doc_id, p.i, p.word, CASE WHEN t.seq IS NULL THEN 0 ELSE 1 END AS starts FROM p LEFT JOIN twice t ON p.seq = t.seq),
gone AS (SELECT doc_id, i, word, max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS removed FROM hit),
told AS (SELECT doc_id, count(*) AS n_words, CAST(sum(removed) AS BIGINT) AS n_removed,
                coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE removed = 0), '') AS kept FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN told USING (doc_id)
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 4 THEN ws ELSE ws[i:i + 3] END, ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS other FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id, d.doc_id <= coalesce(other, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.doc_id = d.doc_id
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, {_WORDS.format("text")} AS ws FROM d),
line AS (SELECT doc_id, source, k, raw,
                {_WORDS.format("translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lw
         FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS k FROM d)),
full_line AS (SELECT doc_id, source, k, raw, array_to_string(lw, ' ') AS line, len(lw) AS n FROM line WHERE len(lw) > 0),
again AS (SELECT doc_id, count(*) AS n_dup_lines FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, raw ORDER BY k) AS r FROM full_line) WHERE r > 1 GROUP BY doc_id),
five AS (SELECT doc_id, i, CASE WHEN i + 4 <= len(ws) THEN array_to_string(ws[i:i + 4], ' ') END AS seq
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
counted AS (SELECT doc_id, i, CASE WHEN seq IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, seq) > 1 THEN 1 ELSE 0 END AS starts FROM five),
inside AS (SELECT doc_id, max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM counted),
repeats AS (SELECT doc_id, CAST(sum(hit) AS BIGINT) AS n_repeat_words FROM inside GROUP BY doc_id),
own AS (SELECT source, text, line, sum(n) AS n, min(k) AS k, any_value(n_words) AS n_words
        FROM (SELECT DISTINCT f.source, w.text, f.k, f.line, f.n, len(w.ws) AS n_words FROM full_line f JOIN w USING (doc_id)) GROUP BY source, text, line),
many AS (SELECT source, line FROM own GROUP BY source, line HAVING count(*) > 20),
found AS (SELECT o.* FROM own o JOIN many m ON o.line = m.line AND o.source IS NOT DISTINCT FROM m.source),
class AS (SELECT source, text, arg_max(line, (n, -k)) AS longest, sum(n) AS gone, any_value(n_words) AS n_words FROM found GROUP BY source, text),
kind AS (SELECT source, text, CASE WHEN n_words - gone < 5 OR n_words - gone < 0.1 * n_words THEN 'copies ' || longest ELSE 'text ' || text END AS class FROM class),
above AS (SELECT f.source, f.line FROM found f JOIN kind c ON f.text = c.text AND f.source IS NOT DISTINCT FROM c.source GROUP BY f.source, f.line HAVING count(DISTINCT class) > 20),
gone AS (SELECT o.source, o.text, CAST(sum(o.n) AS BIGINT) AS n_line_words, count(*) AS n_lines_removed
         FROM own o JOIN above a ON o.line = a.line AND o.source IS NOT DISTINCT FROM a.source GROUP BY o.source, o.text),
removed AS (SELECT w.doc_id, n_line_words, n_lines_removed FROM w JOIN gone g ON w.text = g.text AND w.source IS NOT DISTINCT FROM g.source),
told AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
                coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_line_words, 0) AS n_line_words
         FROM w LEFT JOIN again USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                  n_line_words > 0 AND (n_words - n_line_words < 5 OR n_words - n_line_words < 0.1 * n_words) AS depleted FROM told)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept, n_lines_removed, n_line_words FROM judged
"""

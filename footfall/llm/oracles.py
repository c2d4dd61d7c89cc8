"""DuckDB SQL for those numbered queries that SQL can express."""

from __future__ import annotations

OP6 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rule, rule_host, rule_path, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), best AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM p LEFT JOIN r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""

OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(23 + length(role) + length(text)
         + len(regexp_extract_all(role, '[<\[]\\*(\|[A-Za-z_]+\|>|/?s>|/?INST\])'))
         + len(regexp_extract_all(text, '[<\[]\\*(\|[A-Za-z_]+\|>|/?s>|/?INST\])'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL
  ) JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""

OP9 = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS often
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)
), again AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM grams, range(8) t(j) WHERE often > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS k
  FROM f WHERE source IS NOT NULL GROUP BY source
), one AS (SELECT sum(n) AS n, sum(k) AS k, sum(n * n) AS nn, sum(k * k / n) AS kk, count(*) AS hosts FROM h),
mean AS (SELECT *, (k + 0.5) / (n + 1.0) AS mean, n - nn / n AS room FROM one),
spread AS (
  SELECT mean, mean * (1 - mean) AS chance,
         CASE WHEN room > 0 THEN (kk - k * k / n - (hosts - 1) * mean * (1 - mean)) / room ELSE 0.0 END AS between_ FROM mean
), prior AS (SELECT mean, chance / least(greatest(between_, chance / 1001.0), chance / 2.0) - 1.0 AS weight FROM spread),
verdicts AS (SELECT source, (k + mean * weight) / (n + weight) <= 0.5 AS host_kept FROM h, prior)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_kept, true) AS kept
FROM f LEFT JOIN verdicts USING (source)
"""

OP10 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
), u AS (
  SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v
  WHERE label IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(x, lambda c: c <> 0)) > 0
), l AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_inner_product(p.x, q.x) / (p.norm * q.norm) >= 0.98
), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = vec_id
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = vec_id
"""

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
f AS (
  SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS n FROM (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, range(1, 6) t(size))
  ) GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, size, phrase, n AS a, k, string_split(phrase, ' ') AS w FROM f, range(1, 5) t(k) WHERE k < size
), scored AS (
  SELECT c.lang, c.size, c.phrase, a, l.n AS l, r.n AS r, t.n AS n, 1000 * a * t.n // (l.n * r.n) AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 1000 * a * t.n // (l.n * r.n), k) AS place
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ') JOIN total t ON t.lang = c.lang
), kept AS (
  SELECT * FROM scored s WHERE place = 1 AND NOT EXISTS (
    SELECT 1 FROM f g WHERE g.lang = s.lang AND g.size > s.size AND g.n >= s.a AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' '))
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


def _whole(scale: int, label: str) -> str:
    return f"""v AS (
  SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS q, c.vec_id AS c, q.label = c.label AS same, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)"""


OP12 = f"""
WITH {_whole(256, "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")}, p AS (
  SELECT q, c, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS place FROM s WHERE same
), n AS (
  SELECT p.q, p.c AS positive, p.score AS positive_score, s.c, s.score,
         row_number() OVER (PARTITION BY p.q, p.c ORDER BY s.score DESC, s.c) AS rank
  FROM p JOIN s ON s.q = p.q AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE place <= 5
)
SELECT q AS anchor_id, positive AS positive_id, CAST(rank AS INT) AS rank, c AS negative_id, positive_score, score AS negative_score
FROM n WHERE rank <= 10
"""

OP13 = f"""
WITH {_whole(1024, "0")}
SELECT q AS query_id, CAST(rank AS INT) AS rank, c AS vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM s) WHERE rank <= 10
"""


def oracles() -> dict[str, str]:
    return {
        "op5_jaccard_join": OP5, "op6_url_rules": OP6, "op7_chat_format": OP7, "op9_host_rules": OP9,
        "op10_vector_near_dup": OP10, "op11_phrases": OP11, "op12_hard_negatives": OP12, "op13_pivot_search": OP13,
    }

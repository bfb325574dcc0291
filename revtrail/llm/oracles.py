"""DuckDB SQL for the contract queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) < 8 THEN w ELSE w[i : i + 7] END AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 6))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), places AS (
  SELECT rid, i, n, w[i : i + n - 1] AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
), hits AS (SELECT rid, i, n, item_id FROM places JOIN windows USING (win)),
hit_words AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM hits) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN items USING (rid)
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

OP6 = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT rid, i, md5(b[i + 1 : i + 400]) AS w FROM (SELECT rid, b, unnest(range(0, octet_length(b) - 399)) AS i FROM docs)),
often AS (SELECT w FROM starts GROUP BY w HAVING count(*) > 1),
marked AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM starts JOIN often USING (w)),
edges AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS k FROM marked),
spans AS (SELECT rid, k, min(i) AS a, max(i) + 400 AS z FROM edges GROUP BY rid, k),
cut AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM spans GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(array_to_string(list_transform(list_zip(list_concat([0], coalesce(ends, [])), list_concat(coalesce(starts, []), [octet_length(b)])), lambda p: hex(b[p[1] + 1 : p[2]])), ''))) AS kept_sha256
FROM docs LEFT JOIN cut USING (rid)
"""

#: For pages as the test tables have them: one article of headings, paragraphs and inline markup.
OP7 = r"""
WITH articles AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:h1|p|br)[^>]*>', chr(1), 'g'), '<[^>]*>', '', 'g') AS t FROM pages
), blocks AS (
  SELECT page_id, url, list_filter(list_transform(string_split(regexp_replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), chr(1)),
    lambda x: trim(regexp_replace(x, '[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))), lambda x: x <> '') AS b FROM articles
)
SELECT page_id, url, array_to_string(b, chr(10)) AS text, CAST(length(array_to_string(b, chr(10))) AS BIGINT) AS n_chars FROM blocks
"""

_RULES = """(VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS r(kind, rh, rp)"""

OP8 = rf"""
WITH RECURSIVE
tags AS (
  SELECT url AS source, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
), attrs AS (
  SELECT source, tag, lower(regexp_extract(tag, '(?is)\srel\s*=\s*["'']?([^"''>]*)', 1)) AS rel, regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''>]*)', 1) AS href,
         lower(regexp_extract(tag, '(?is)\shttp-equiv\s*=\s*["'']?([^"''>]*)', 1)) AS equiv, regexp_extract(tag, '(?is)\scontent\s*=\s*["'']?[^;,"'']*[;,]\s*url\s*=\s*[''"]?([^''"]*)', 1) AS refresh
  FROM tags
), links AS (
  SELECT source, replace(trim(CASE WHEN tag ILIKE '<link%' AND contains(' ' || rel || ' ', ' canonical ') THEN href WHEN tag ILIKE '<meta%' AND trim(equiv) = 'refresh' THEN refresh END), '&amp;', '&') AS link
  FROM attrs
), targets AS (
  SELECT source, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN split_part(source, '://', 1) || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(source, '^(.*?://[^/?#]*)', 1) || link
    ELSE regexp_extract(source, '^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(source, '://[^/?#]*(/?(?:[^?#]*/)?)', 1), ''), '/') || link END AS target
  FROM links WHERE link <> ''
), all_urls AS (SELECT source AS u FROM targets UNION SELECT target FROM targets UNION SELECT url FROM pages),
parts AS (
  SELECT u, CASE WHEN instr(u, '://') > 0 THEN translate(regexp_extract(substr(u, instr(u, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN instr(u, '://') > 0 THEN regexp_extract(substr(u, instr(u, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM all_urls
), ruled AS (
  SELECT p.u, p.host, p.path, rh || rp AS rule, kind, row_number() OVER (PARTITION BY p.u ORDER BY length(rh || rp) DESC NULLS LAST, kind) AS k,
         CASE WHEN p.host <> '' THEN lower(split_part(p.u, '://', 1)) || '://' || p.host || CASE WHEN p.path = '' THEN '/' ELSE p.path END || regexp_extract(p.u, '^[^?#]*([?][^#]*)', 1) END AS key
  FROM parts p LEFT JOIN {_RULES} ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)
), urls AS (SELECT * FROM ruled WHERE k = 1),
edges AS (
  SELECT a.key AS x, b.key AS y FROM targets JOIN urls a ON a.u = source JOIN urls b ON b.u = target WHERE a.key <> b.key
), both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach(x, y) AS (SELECT DISTINCT x, x FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
spread AS (SELECT r.x AS key, min(u.kind) AS spread FROM reach r JOIN urls u ON u.key = r.y GROUP BY r.x)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(kind, spread, 'allow') AS verdict
FROM pages LEFT JOIN urls ON urls.u = pages.url LEFT JOIN spread USING (key)
"""

ORACLES: dict[str, str] = {"op2_decontamination": OP2, "op5_topk": OP5, "op6_suffix_dedup": OP6, "op7_html": OP7, "op8_url_filter": OP8}

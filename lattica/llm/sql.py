"""DuckDB SQL for the queries of these operators that it can express; tests hold the others against brute force."""

from __future__ import annotations

_WARC = """
WITH raw AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, url, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM raw),
groups AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS last FROM hashed),
-- 5 hexadecimal digits are 20 bits, so 4 digits of base 32
quads AS (SELECT *, [('0x' || substr(hex, 5 * k + 1, 5))::BIGINT FOR k IN range(8)] AS parts FROM groups)
SELECT page_id, payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[1 + k // 4] >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1) FOR k IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to, url
FROM quads
"""

_SHARDS = r"""
-- the table of the usual CRC-32, then a fold over each text's bytes
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
raw AS (SELECT row_number() OVER () AS id, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
bytes AS (SELECT id, doc_id, octet_length(raw) + 1 AS size, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM raw),
sized AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, crc),
placed AS (SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS total, row_number() OVER w AS place FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, ((2 * upto - size) * 16 // (2 * total))::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard FROM cut
"""

_NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)] END) AS s
  FROM words),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_in p JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
reach AS (SELECT doc_id AS id, doc_id AS to_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.to_id),
component AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN component ON id = d.doc_id LEFT JOIN size USING (doc_id)
"""

_DIVERGENCE = r"""
WITH named AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
used AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM named),
kept AS (SELECT lang, term, count(*) AS n FROM used GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
lang_total AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM used SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM named),
grp_total AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM grp LEFT JOIN counted USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * t.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 2) // (t.total + 2 * t.v) AS q
  FROM grp_total g JOIN kept k USING (lang) JOIN lang_total t USING (lang) LEFT JOIN counted c USING (lang, source, term)),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_TRIE = r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
turns AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, digest, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS d FROM turns),
ids AS (SELECT conv_id, count(*) AS n, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM own GROUP BY conv_id),
conv AS (SELECT conv_id, n, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 6 AS h FROM ids, crc),
rebuilt AS (
  SELECT c.conv_id, o.d AS depth, o.digest, o.chars FROM conv c JOIN own o ON o.conv_id = c.base WHERE o.d <= c.h
  UNION ALL SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + o.d - c.h, o.digest, o.chars FROM conv c JOIN own o USING (conv_id) LEFT JOIN ids b ON b.conv_id = c.base WHERE o.d > c.h),
path AS (
  SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS node, chars FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM conv),
node AS (SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM path GROUP BY node),
kin AS (SELECT k.node, p.node AS above, q.conv_id AS parent_conv_id FROM node k JOIN path p ON p.conv_id = k.conv_id AND p.depth = k.depth - 1 JOIN node q ON q.node = p.node),
kids AS (SELECT above AS node, count(*) AS n_children FROM kin GROUP BY above),
sums AS (SELECT p.node, sum((k.n - 1) * k.chars) AS saved, count(*) FILTER (c.n_children IS NULL) AS leaves
  FROM node k LEFT JOIN kids c ON c.node = k.node JOIN path p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY p.node),
ends AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, depth) AS node FROM path GROUP BY conv_id) GROUP BY node)
SELECT k.conv_id, k.depth, parent_conv_id, k.n AS n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node k LEFT JOIN kin USING (node) LEFT JOIN kids USING (node) JOIN sums USING (node) LEFT JOIN ends USING (node)
"""

ORACLE = {"op2_shards": _SHARDS, "op4_warc": _WARC, "op9_near_duplicates": _NEAR, "op11_ngram_join": _NEAR.replace("< 5", "< 4").replace("k + 4", "k + 3").replace("- 3)", "- 2)").replace(", d.doc_id = component_id AS kept", ""),
          "op12_prefix_trie": _TRIE, "op13_divergence": _DIVERGENCE}

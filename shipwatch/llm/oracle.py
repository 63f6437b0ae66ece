"""DuckDB SQL of the queries that SQL can express."""

OP5 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, ks WHERE len(ws) >= k)),
hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13)),
low AS (SELECT win, min(doc_id) AS low FROM win GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p
  FROM win JOIN low USING (win) WHERE low < doc_id),
words AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS p FROM w WHERE len(ws) > 0),
kept AS (
  SELECT doc_id, string_agg(ws[p], ' ' ORDER BY p) FILTER (WHERE g IS NULL) AS kept, count(g) AS n_removed
  FROM (SELECT words.doc_id, words.ws, words.p, gone.p AS g FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p)
  GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLE: dict[str, str] = {"op5_decontaminate": OP5, "op6_substring_dedup": OP6}

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE["op2_maxscore"] = OP2

OP3 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (
  SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS top,
         list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST('0x' || substr(h || '0', 1 + CAST(floor(i * 5 / 4) AS INT), 2) AS INT) >> CAST(3 - (i * 5) % 4 AS INT)) & 31 AS INT), 1)) AS letters
  FROM p)
SELECT page_id, payload_bytes, array_to_string(letters, '') AS payload_digest,
       CASE WHEN top IS DISTINCT FROM page_id AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM bits
"""

ORACLE["op3_warc"] = OP3

#: crc32 by its table of 256 entries, which is built from the reflected polynomial
OP13 = """
WITH crc AS (
  SELECT list_transform(generate_series(0, 255), lambda x: list_reduce(
           [x::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
base AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
             lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM base), crc),
turns AS (
  SELECT i.conv_id, b.pos, b.role, b.text FROM ids i JOIN base b ON b.conv_id = i.base WHERE b.pos <= i.h
  UNION ALL
  SELECT i.conv_id, b.pos, b.role, b.text FROM ids i JOIN base b ON b.conv_id = i.conv_id WHERE b.pos > i.h),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
         list(sha256(strlen(role) || ':' || role || text)) OVER w AS path
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
paths AS (
  SELECT conv_id, depth, bytes, sha256(array_to_string(path, '')) AS node,
         CASE WHEN depth > 1 THEN sha256(array_to_string(path[:-2], '')) ELSE '' END AS parent FROM steps
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM ids),
ended AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (
  SELECT node, any_value(p.depth) AS depth, any_value(parent) AS parent, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE p.depth = e.depth), '')) AS ends_sha256
  FROM paths p JOIN ended e USING (conv_id) GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
weights AS (
  SELECT n.conv_id, n.depth, (n.n_convs - 1) * n.bytes AS saved, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf
  FROM nodes n LEFT JOIN children c USING (node)),
subtree AS (
  SELECT p.node, sum(saved) AS saved, sum(leaf) AS leaves
  FROM weights w JOIN paths p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtree s USING (node) LEFT JOIN children c ON c.node = n.node LEFT JOIN nodes u ON u.node = n.parent
"""

ORACLE["op13_prefix_trie"] = OP13

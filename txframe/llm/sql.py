"""DuckDB SQL for the operators whose whole result SQL can express.

The others hold a learned model, a hash-drawn sample, or a similarity join whose quadratic form
is too slow on whole tables; tests/llm compares them with brute force instead.
"""

#: Op 2: what a WARC round trip must give back.
OP2 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, octet_length(encode(h)) AS b, sha1(h) AS s FROM p),
f AS (SELECT s, max(page_id) AS first FROM d WHERE b >= 1000 GROUP BY s)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d.s AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to, url
FROM d LEFT JOIN f ON d.s = f.s
"""

#: Op 4: windows of eight words looked up as joined strings.
OP4 = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 8) AS n, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
cut AS (SELECT doc_id, t, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, t, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, t, c.n, i, item_id FROM cut c JOIN wins USING (win)),
words AS (SELECT doc_id, t, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, t, unnest(range(i, i + n)) AS p FROM hit) GROUP BY ALL),
named AS (SELECT doc_id, t, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, t, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY ALL)
SELECT DISTINCT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs d LEFT JOIN words x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.t = x.t LEFT JOIN named y ON d.doc_id IS NOT DISTINCT FROM y.doc_id AND d.t = y.t
"""

CHAT_QUOTING = """
WITH RECURSIVE c AS (SELECT conv_id, turn, trim('m' || turn || ' ' || trim(regexp_replace(coalesce(text, ''), '[ \t\n\f\r]+', ' ', 'g'))) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT c.conv_id, c.turn, c.text, CASE WHEN c.turn > 0 THEN q.turn END AS parent_turn FROM c LEFT JOIN c q ON q.conv_id = c.conv_id AND q.turn = (c.turn - 1) // 2 AND c.turn > 0),
t AS (SELECT conv_id, turn, parent_turn, text, turn AS thread, CAST(0 AS BIGINT) AS depth FROM p WHERE parent_turn IS NULL
 UNION ALL SELECT p.conv_id, p.turn, p.parent_turn, p.text, t.thread, t.depth + 1 FROM p JOIN t ON p.conv_id = t.conv_id AND p.parent_turn = t.turn)
SELECT conv_id, turn, thread, parent_turn, depth, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn) - 1 AS position, CAST(parent_turn IS NOT NULL AS BIGINT) AS n_quotes, text FROM t
"""

CHAT_ASSEMBLED = CHAT_QUOTING.removesuffix("\n").rsplit("\nSELECT", 1)[0] + """,
o AS (SELECT t.conv_id, coalesce(role, 'unknown') || ': ' || t.text AS said, row_number() OVER (PARTITION BY t.conv_id ORDER BY thread, t.turn) - 1 AS position FROM t JOIN conversations USING (conv_id, turn))
SELECT conv_id, position // 64 AS piece, position // 64 * 64 AS first_position, count(*) AS n_messages, string_agg(said, chr(10) || chr(10) ORDER BY position) AS text FROM o GROUP BY conv_id, position // 64
"""

ORACLES = {"op2_warc": OP2, "op4_decontaminate": OP4, "chat_quoting": CHAT_QUOTING, "chat_assembled": CHAT_ASSEMBLED}

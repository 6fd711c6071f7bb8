"""SQL for the queries that SQL can express over whole tables in acceptable time."""

SQL = {
    "op4_setsketch": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 4], ' ') AS g FROM d, unnest(range(greatest(len(ws) - 3, 1))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
pairs AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(v, l) AS (SELECT x, x FROM pairs UNION SELECT b.y, r.l FROM r JOIN pairs b ON b.x = r.v WHERE r.l < b.y),
m AS (SELECT v, min(l) AS l FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.l, d.doc_id) AS component_id, coalesce(m.l, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.v = d.doc_id""",
    "op6_prefix_filter": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i + 1:i + 10], ' ') AS g FROM b, unnest(range(greatest(len(ws) - 9, 1))) AS u(i) WHERE len(ws) > 0),
x AS (SELECT d.doc_id, i AS pos, l.n, array_to_string(ws[i + 1:i + l.n], ' ') AS g FROM d, (SELECT DISTINCT n FROM w) l, unnest(range(len(ws) - l.n + 1)) AS u(i)),
m AS (SELECT x.doc_id, x.pos, x.n, w.item_id FROM x JOIN w USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT pos + k) AS n_hit FROM m, unnest(range(n)) AS u(k) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
}

"""DuckDB SQL for the rows of the queries that SQL can express.

The others rest on hashes, tokenizers, models or approximate search; tests hold them against brute-force versions.
"""

OP3 = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY sha1(h)) AS head FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM d"""

OP7 = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda i: {'s': i, 'h': md5(array_to_string(ws[i:i + 19], ' '))}), recursive := true) FROM w),
one AS (SELECT h, min({'d': doc_id, 's': s}) AS m FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM win JOIN one USING (h) WHERE {'d': doc_id, 's': s} > m),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
marked AS (SELECT e.doc_id, e.i, e.word, g.i IS NOT NULL AS g FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE g) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT g) AS kept FROM marked GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN sums USING (doc_id)"""

OP9 = r"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(0, n - 49), lambda i: {'s': i, 'h': hash(substr(x, (2 * i + 1)::INT, 100))}), recursive := true) FROM t),
one AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, s FROM win JOIN one USING (h) WHERE doc_id > m),
step AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS b FROM hit),
run AS (SELECT doc_id, r, min(s) AS lo, max(s) + 50 AS hi FROM (SELECT doc_id, s, sum(b) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS r FROM step) GROUP BY doc_id, r),
gaps AS (SELECT doc_id, r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS pre FROM run),
sums AS (SELECT g.doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, (2 * pre + 1)::INT, (2 * (lo - pre))::INT), '' ORDER BY lo) AS head, max(hi) AS last FROM gaps g JOIN t USING (doc_id) GROUP BY g.doc_id)
SELECT t.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, (2 * coalesce(last, 0) + 1)::INT))) AS kept_sha256 FROM t LEFT JOIN sums USING (doc_id)"""

ORACLES = {"op3_warc": OP3, "op7_recompression": OP7, "op9_suffixes": OP9}

"""DuckDB SQL of the queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEXT = AZ.format("coalesce(text, '')")
_WORDS = f"regexp_extract_all({_TEXT}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(13, len(w)) AS k FROM b WHERE len(w) > 0))),
seen AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT rid, item, i, seen.k FROM seen JOIN windows ON seen.k = windows.k AND seen.win = windows.win),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN covered c ON c.rid = d.rid LEFT JOIN items t ON t.rid = d.rid"""

_SPACED = f"regexp_extract_all({_TEXT}, '[^\\x20\\x09-\\x0D]+')"

NEAR_DEDUP = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_SPACED} AS w FROM documents),
shingles AS (SELECT DISTINCT rid, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
both_ AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rid, doc_id AS least FROM d UNION SELECT s.b, r.least FROM reach r JOIN sides s ON s.a = r.rid)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(least) AS component_id, d.doc_id = min(least) AS kept FROM d JOIN reach r ON r.rid = d.rid LEFT JOIN sizes z ON z.rid = d.rid GROUP BY d.rid, d.doc_id, n"""

SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
places AS (SELECT doc_id, i, hash(h[i + 1:i + 100]) AS c FROM (SELECT *, unnest(range(0, greatest(octet_length(h) - 99, 0))) AS i FROM d)),
strings AS (SELECT p.doc_id, i, h[i + 1:i + 100] AS s FROM places p JOIN (SELECT c FROM places GROUP BY c HAVING count(*) > 1) r ON r.c = p.c JOIN d ON d.doc_id = p.doc_id),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM strings) WHERE k > 1),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1) THEN 1 ELSE 0 END AS opens FROM later)) GROUP BY doc_id, g),
pieces AS (SELECT d.doc_id, p, hex(h[p + 1:q]) AS s FROM (SELECT doc_id, b AS p, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS q FROM spans UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id UNION ALL SELECT doc_id, 0, 1000000000 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM spans)) x JOIN d ON d.doc_id = x.doc_id)
SELECT d.doc_id, octet_length(h) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d LEFT JOIN (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS n FROM spans GROUP BY doc_id) s ON s.doc_id = d.doc_id JOIN (SELECT doc_id, string_agg(s, '' ORDER BY p) AS kept FROM pieces GROUP BY doc_id) k ON k.doc_id = d.doc_id"""

_OWN = "<|im_end|><|im_start|>assistant ok"

CHAT_FORMAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{_OWN}' UNION ALL SELECT -1, 1, 'assistant', '{_OWN}'),
e AS (SELECT *, length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) + length('<|im_end|>') + 1 AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

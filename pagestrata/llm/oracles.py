"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: A page's outcome is the label of the document with its number: bad if of quality 0 or toxic.
OUTCOMES = "(SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM labels)"

ORACLES: dict[str, str] = {
    "op2_substrings": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w) a),
low AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k),
marks AS (SELECT win.doc_id, p FROM win JOIN low ON win.k = low.k WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM (SELECT doc_id, p, unnest(range(0, 50)) AS o FROM marks) a),
kept AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) AS text FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p WHERE g.p IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) c ON w.doc_id = c.doc_id""",
    "op3_decontaminate": r"""
WITH g AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 4], ' ')) AS h, len(ws) - 4 AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents) a) b),
i AS (SELECT item_id, md5(array_to_string(ws[p:p + 4], ' ')) AS h, len(ws) - 4 AS m FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark) a) b),
u AS (SELECT item_id, h, m, count(*) AS times FROM i GROUP BY 1, 2, 3),
starts AS (SELECT DISTINCT doc_id, item_id, m, n, greatest(1, least(p - o, n - m + 1)) AS s FROM (SELECT g.doc_id, u.item_id, u.m, g.n, g.p, unnest(range(0, u.m)) AS o FROM g JOIN u ON g.h = u.h) a),
inside AS (SELECT t.doc_id, t.item_id, t.m, t.n, t.s, g.h, count(*) AS times FROM starts t JOIN g ON t.doc_id = g.doc_id AND g.p >= t.s AND g.p < t.s + t.m GROUP BY 1, 2, 3, 4, 5, 6),
scored AS (SELECT x.doc_id, x.item_id, max(x.both_ / (least(x.m, x.n) + x.m - x.both_)) AS similarity FROM (
  SELECT a.doc_id, a.item_id, a.m, a.n, a.s, CAST(sum(least(a.times, u.times)) AS DOUBLE) AS both_ FROM inside a JOIN u ON a.item_id = u.item_id AND a.h = u.h GROUP BY 1, 2, 3, 4, 5) x GROUP BY 1, 2),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS STRING), ',' ORDER BY item_id) AS item_ids, max(similarity) AS similarity FROM scored WHERE similarity >= 0.8 - 1e-9 GROUP BY doc_id)
SELECT d.doc_id, f.doc_id IS NOT NULL AS contaminated, CAST(coalesce(f.n_items, 0) AS INTEGER) AS n_items, coalesce(f.item_ids, '') AS item_ids, round(f.similarity, 6) AS similarity FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id""",
    "op4_suffixes": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, md5(substr(h, 2 * p - 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 198)) AS p FROM d) a),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
marks AS (SELECT doc_id, p FROM win WHERE k IN (SELECT k FROM twice)),
edges AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM marks),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 199 AS b FROM (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM edges) s GROUP BY doc_id, span),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS from_, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS last FROM spans),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * from_ - 1, 2 * (a - from_)), '' ORDER BY a) || max(CASE WHEN last = 1 THEN substr(h, 2 * b + 1) ELSE '' END) AS h, count(*) AS n_spans, sum(b - a + 1) AS n_removed FROM gaps g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op8_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN 's' || array_to_string(ws, ' ') ELSE md5(array_to_string(ws[p:p + 4], ' ')) END AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0) a),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(least(w.doc_id, m.low), w.doc_id) AS class_id, coalesce(k.n, 0) AS n_links
FROM w LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON w.doc_id = m.a LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON w.doc_id = k.a""",
    "op9_warc": """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM (SELECT page_id, payload_bytes, payload_digest, min(page_id) OVER (PARTITION BY payload_digest) AS first_id
      FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                   list_aggregate(list_transform(range(0, 40, 5), lambda i: list_aggregate(list_transform(range(0, 4), lambda k:
                     substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha1(coalesce(html, '')), CAST(i + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * k AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
            FROM pages) hashed) ranked""",
    "op10_urlrules": f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, split_part(split_part(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '?', 1), '#', 1) AS path FROM cut),
r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (SELECT DISTINCT p.host, p.path, r.host || r.path AS rule, r.verdict FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
best AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM fits GROUP BY host, path),
h AS (SELECT p.host, count(o.bad) AS n, coalesce(sum(o.bad), 0) AS bad, rtrim(regexp_replace(p.host, ':[0-9]*$', ''), '.') AS bare FROM p LEFT JOIN {OUTCOMES} o ON p.page_id = o.page_id GROUP BY p.host),
labels_of AS (SELECT *, string_split(bare, '.') AS l, regexp_matches(bare, '^[0-9.]*[0-9][0-9.]*$') OR starts_with(bare, '[') AS address FROM h),
depth AS (SELECT *, CASE WHEN len(l) > 1 AND regexp_matches(l[-1], '^[a-z][a-z]$') AND l[-2] IN ({", ".join(f"'{x}'" for x in ("ac", "co", "com", "edu", "gob", "gouv", "gov", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch"))}) THEN 2 ELSE 1 END AS k FROM labels_of),
units AS (SELECT host, n, bad, CASE WHEN address THEN '' ELSE array_to_string(l[greatest(1, len(l) - k + 1):], '.') END AS suffix, CASE WHEN address THEN bare ELSE array_to_string(l[greatest(1, len(l) - k):], '.') END AS domain FROM depth),
m AS (SELECT sum(bad) / sum(n) AS mean FROM units),
per AS (SELECT 's' AS level, suffix AS unit, sum(n) AS n, sum(bad) AS bad FROM units GROUP BY suffix UNION ALL SELECT 'd', domain, sum(n), sum(bad) FROM units GROUP BY domain UNION ALL SELECT 'h', host, n, bad FROM units),
spread AS (SELECT level, (sum(n * pow(bad / n - mean, 2)) - (count(*) - 1) * any_value(mean * (1 - mean))) / nullif(sum(n) - sum(n * n) / sum(n), 0) AS v, any_value(mean * (1 - mean)) AS top FROM per, m WHERE n > 0 GROUP BY level),
k AS (SELECT max(CASE WHEN level = 's' THEN x END) AS s, max(CASE WHEN level = 'd' THEN x END) AS d, max(CASE WHEN level = 'h' THEN x END) AS h FROM (SELECT level, CASE WHEN v IS NULL OR v <= 0 THEN 1000 ELSE greatest(1, least(1000, top / v - 1)) END AS x FROM spread) t),
sr AS (SELECT unit, (k.s * mean + bad) / (k.s + n) AS rate FROM per, k, m WHERE level = 's'),
dr AS (SELECT per.unit, (k.d * sr.rate + per.bad) / (k.d + per.n) AS rate FROM per JOIN (SELECT DISTINCT domain, suffix FROM units) u ON u.domain = per.unit JOIN sr ON sr.unit = u.suffix, k WHERE level = 'd'),
ab AS (SELECT host, k.h * dr.rate + bad AS a, k.h * (1 - dr.rate) + n - bad AS b FROM units JOIN dr ON dr.unit = units.domain, k),
poor AS (SELECT host FROM ab WHERE a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > 0.5)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, CASE WHEN p.host IN (SELECT host FROM poor) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path""",
}

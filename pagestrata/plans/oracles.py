"""DuckDB SQL with the same rows as each query of the catalogue."""

from __future__ import annotations

from pagestrata.functions.digests import EMPTY_SHA256
from pagestrata.operators.classify import AUTO_RESUME, NO_AUTO_RESUME, TRANSITIONS
from pagestrata.plans.adapters import oracle_view as v

_quoted = lambda names: ", ".join(f"'{n}'" for n in names)

_VERDICT = """
CASE WHEN body IS NULL OR body = '' THEN 'unknown/empty_body'
     WHEN host = '' THEN 'unknown/malformed_url'
     WHEN host = 'sec.example.com' OR host LIKE '%.sec.example.com' THEN CASE WHEN captcha THEN 'challenge/' ELSE 'blocked/' END
     WHEN regexp_matches(body, '<title>\\s*Sign in\\s*</title>') THEN 'login/'
     WHEN status = 404 THEN 'gone/' WHEN status IN (403, 429, 418) THEN 'blocked/'
     WHEN status >= 500 THEN 'unknown/server_error' WHEN status <> 200 THEN 'unknown/unexpected_status'
     WHEN regexp_matches(body, 'unusual requests|too many requests') THEN CASE WHEN captcha THEN 'challenge/' ELSE 'blocked/' END
     WHEN contains(body, 'Page not found') THEN 'soft404/'
     WHEN NOT contains(body, '<html') THEN 'login/'
     WHEN NOT contains(body, '<title>') THEN 'unknown/frame_anchors_missing' ELSE 'ok/' END"""
_CLASSIFIED = f"""(SELECT page_id, split_part(both_, '/', 1) AS verdict, nullif(split_part(both_, '/', 2), '') AS verdict_reason, item_count FROM (
  SELECT page_id, {_VERDICT} AS both_, CAST(len(regexp_extract_all(body, '<li>')) AS INTEGER) AS item_count FROM (
    SELECT *, lower(regexp_extract(final_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS host, regexp_matches(lower(body), 'captcha') AS captcha FROM {v("responses")}) r) c) classified"""
_MOVES = " ".join(f"WHEN '{a}' THEN '{b}|{str(c).lower()}|{d or ''}'" for a, b, c, d in TRANSITIONS)

_NEWS = f"""(SELECT p.route_key, p.page, p.n_ids, coalesce(f.new_ids, 0) AS new_ids, p.n_ids - coalesce(f.new_ids, 0) AS duplicates
  FROM (SELECT route_key, page, count(id) AS n_ids FROM {v("items")} GROUP BY route_key, page) p
  LEFT JOIN (SELECT route_key, page, count(*) AS new_ids FROM (SELECT route_key, id, min(page) AS page FROM {v("items")} WHERE id IS NOT NULL GROUP BY route_key, id) a GROUP BY route_key, page) f
    ON p.route_key = f.route_key AND p.page = f.page) news"""
_STALLS = f"""(SELECT route_key, page, n_ids, new_ids, duplicates, barren, empties, barren >= 3 OR empties >= 2 AS stalled FROM (
  SELECT *, sum(CASE WHEN new_ids = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY route_key, b ORDER BY page) AS barren,
         sum(CASE WHEN n_ids = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY route_key, e ORDER BY page) AS empties
  FROM (SELECT *, sum(CASE WHEN new_ids = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY route_key ORDER BY page) AS b,
               sum(CASE WHEN n_ids = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY route_key ORDER BY page) AS e FROM {_NEWS}) i) j) stalls"""

_OTHER = f"""(SELECT bundle_id, name, CASE WHEN n % 7 = 2 AND name = 'f1' THEN bytes + 1 ELSE bytes END AS bytes
  FROM (SELECT *, CAST(substr(bundle_id, 2, 9) AS INTEGER) AS n FROM {v("files")}) x WHERE NOT (n % 5 = 1 AND name = 'f2') AND n % 9 <> 4)"""
_RELATION = f"""(SELECT bundle_id, CASE WHEN other THEN 'different' WHEN missing THEN 'partial' ELSE 'same' END AS relation FROM (
  SELECT bundle_id, bool_or(t IS NOT NULL AND s IS DISTINCT FROM t) AS other, bool_or(t IS NULL) AS missing, count(t) AS present FROM (
    SELECT coalesce(a.bundle_id, b.bundle_id) AS bundle_id, a.bytes AS s, b.bytes AS t
    FROM (SELECT * FROM {v("files")}) a FULL JOIN {_OTHER} b ON a.bundle_id = b.bundle_id AND a.name = b.name) u
  GROUP BY bundle_id) g WHERE present > 0)"""

_WALK = """WITH RECURSIVE b AS (SELECT * FROM {bundles}), walk AS (
  SELECT bundle_id AS head, bundle_id, previous_bundle_id AS next_id, 0 AS depth, [bundle_id] AS path FROM b {starts}
  UNION ALL SELECT w.head, b.bundle_id, b.previous_bundle_id, w.depth + 1, list_append(w.path, b.bundle_id) FROM walk w JOIN b ON w.next_id = b.bundle_id WHERE NOT list_contains(w.path, b.bundle_id))"""

ORACLES: dict[str, str] = {
    "url_key": r"""
WITH t(k, tail) AS (VALUES (0, ''), (1, '?utm_source=a&z=1&a=2&a=1'), (2, '?q=a%20b&p=c+d&%75tm_term=x'), (3, '?e=%zz&f=%C3%A9&g=é&h=~*-._'), (4, '?flag&empty=&&=v#frag?x=1'), (5, '/a/./b/../c d/é'), (6, '/x%2Fy/<z>'), (7, '?start=1&sort=t&ck=9')),
want(k, path, query) AS (VALUES (0, '', ''), (1, '', '?a=2&a=1&z=1'), (2, '', '?p=c+d&q=a+b'), (3, '', '?e=%25zz&f=%C3%A9&g=%C3%A9&h=%7E*-._'), (4, '', '?=v&empty=&flag='), (5, '/a/c%20d/%C3%A9', ''), (6, '/x%2Fy/%3Cz%3E', ''), (7, '', '?sort=t&start=1')),
u AS (SELECT page_id, page_id % 8 AS k, split_part(url, '?', 1) AS base FROM pages),
p AS (SELECT page_id, k, lower(regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://([^/#]+)', 1)) AS host,
             regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/#]+(/[^#]*)', 1) AS path, contains(base, '#') AS cut FROM u)
SELECT page_id, CASE WHEN scheme <> '' AND host <> '' THEN scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
  || CASE WHEN cut THEN CASE WHEN p.path = '' THEN '/' ELSE p.path END ELSE CASE WHEN p.path || want.path = '' THEN '/' ELSE p.path || want.path END || query END END AS url_key
FROM p JOIN want ON p.k = want.k""",
    "url_cursor": "SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=') THEN TRY_CAST(regexp_extract(url, '[?&]page=([^&#]*)', 1) AS BIGINT) ELSE 1 END AS cursor FROM pages",
    "host_rollup": "SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, count(*) AS pages, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1",
    "sha256_hex": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "sha1_base32": """
SELECT page_id, 'sha1:' || list_aggregate(list_transform(range(0, 40, 5), lambda i: list_aggregate(list_transform(range(0, 4), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha1(html), CAST(i + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * k AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS digest FROM pages""",
    "normalized_digest": """
SELECT doc_id, sha256(list_aggregate(list_transform(string_split(replace(replace(nfc_normalize(text || ' ' || chr(9) || chr(13) || chr(10) || 'end  '), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
  lambda l: rtrim(l, ' ' || chr(9) || chr(160) || chr(12288))), 'string_agg', chr(10))) AS digest FROM documents""",
    "capture_id_roundtrip": """
SELECT o_orderkey, '20240101T000000Z-00ff00#' || CASE WHEN length(CAST(o_orderkey * 97 AS STRING)) >= 6 THEN CAST(o_orderkey * 97 AS STRING) ELSE lpad(CAST(o_orderkey * 97 AS STRING), 6, '0') END AS capture_id,
       '20240101T000000Z-00ff00' AS bundle_id, o_orderkey * 97 AS seq, '2024-01-01' AS day FROM orders""",
    "parse_naive_ts": f"""
SELECT event_id, CASE WHEN t IS NOT NULL THEN strftime(t, '%Y-%m-%dT%H:%M:%S') || '+08:00' END AS iso, epoch_ms(t) - 28800000 AS epoch_ms,
       CASE WHEN t IS NOT NULL THEN CASE WHEN contains(raw, ':') THEN 'second' ELSE 'day' END END AS precision
FROM (SELECT event_id, raw, CASE WHEN regexp_matches(raw, '^[0-9]{{4}}-') THEN try_strptime(
        replace(raw, 'T', ' ') || CASE WHEN NOT contains(raw, ':') THEN ' 0:00:00' WHEN length(raw) - length(replace(raw, ':', '')) = 1 THEN ':00' ELSE '' END, '%Y-%m-%d %H:%M:%S') END AS t FROM {v("raw_times")}) x""",
    "backoff_schedule": """
SELECT n_nationkey, CAST(least(1000 * power(2.0, n_nationkey), 60000) AS BIGINT) AS interval_ms,
       CAST(CASE WHEN n_nationkey <= 0 THEN 0 WHEN n_nationkey = 1 THEN 1800000 WHEN n_nationkey = 2 THEN 3600000 ELSE 14400000 END AS BIGINT) AS cooldown_ms FROM nation""",
    "human_bytes": """
SELECT o_orderkey, CASE WHEN n < 1024 THEN CAST(n AS STRING) || ' B' WHEN n < 1048576 THEN CAST(kb // 10 AS STRING) || '.' || CAST(kb % 10 AS STRING) || ' KB'
         WHEN n < 1073741824 THEN CAST(mb // 10 AS STRING) || '.' || CAST(mb % 10 AS STRING) || ' MB' ELSE CAST(gb // 100 AS STRING) || '.' || lpad(CAST(gb % 100 AS STRING), 2, '0') || ' GB' END AS size
FROM (SELECT o_orderkey, n, (n * 20 + 1024) // 2048 AS kb, (n * 20 + 1048576) // 2097152 AS mb, (n * 200 + 1073741824) // 2147483648 AS gb
      FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CAST(power(10.0, o_orderkey % 6) AS BIGINT) // 100 AS n FROM orders) x) y""",
    "classify_pages": f"SELECT page_id, verdict, verdict_reason, item_count FROM {_CLASSIFIED}",
    "verdict_transition": f"""
SELECT page_id, split_part(m, '|', 1) AS state, split_part(m, '|', 2) = 'true' AS stop_run, nullif(split_part(m, '|', 3), '') AS transition_reason
FROM (SELECT page_id, CASE verdict {_MOVES} END AS m FROM {_CLASSIFIED}) x""",
    "verdict_tally": f"SELECT verdict, count(*) AS n FROM {_CLASSIFIED} GROUP BY verdict",
    "resume_policy": f"""
SELECT o_orderkey, pause_reason, quiet AND wait <= 0 AS resume, NOT quiet AS user_visible, pause_reason <> 'something_else' AS known_pause, CAST(CASE WHEN quiet THEN wait ELSE 0 END AS BIGINT) AS cooldown_ms
FROM (SELECT o_orderkey, pause_reason, pause_reason IN ({_quoted(AUTO_RESUME)}) AS quiet, greatest(0, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1800000 WHEN 2 THEN 3600000 ELSE 14400000 END - o_orderkey * 1000) AS wait
      FROM (SELECT o_orderkey, ([{_quoted([*AUTO_RESUME, *NO_AUTO_RESUME, "something_else"])}])[CAST(o_orderkey % {len(AUTO_RESUME) + len(NO_AUTO_RESUME) + 1} + 1 AS BIGINT)] AS pause_reason FROM orders) a) b""",
    "item_pairs": """
SELECT page_id, CAST(pos AS INTEGER) AS pos, item_id, item_time FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, item_id ORDER BY pos) AS turn FROM (
    SELECT page_id, pos, nullif(regexp_extract(part, '<a href="/?([A-Za-z]+)"', 1), '') AS item_id, nullif(regexp_extract(part, '>([A-Z][a-z]+)<', 1), '') AS item_time FROM (
      SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM (
        SELECT page_id, list_transform((string_split(html, '<a href='))[2:], lambda p: '<a href=' || p) AS parts FROM pages) a) b) c WHERE item_id IS NOT NULL) d WHERE turn = 1""",
    "item_ids": """
SELECT page_id, coalesce(string_agg(id, ',' ORDER BY first), '') AS item_ids FROM pages LEFT JOIN (
  SELECT page_id AS pid, id, min(pos) AS first FROM (SELECT page_id, unnest(l) AS id, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="/?([A-Za-z]+)"', 1) AS l FROM pages) a) b GROUP BY 1, 2) c
ON pid = page_id GROUP BY page_id""",
    "item_count": "SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS n FROM pages",
    "detail_links": """SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS INTEGER) AS n_links FROM pages""",
    "strip_comments": "SELECT page_id, CAST(length(regexp_replace(html, '(?s)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<nav\\b[^>]*>.*?</nav>', '', 'g')) AS INTEGER) AS chars_left FROM pages",
    "claimed_delta": f"""
SELECT route_key, bundle_id, captured_count, claimed_count, captured_count - claimed_count AS delta FROM (
  SELECT route_key, bundle_id, count(*) AS captured_count, CASE WHEN max(item_count) > 5 THEN max(item_count) * 10 END AS claimed_count FROM {v("captures")} GROUP BY 1, 2) x""",
    "dq_index_rules": f"""
SELECT capture_id, rtrim(CASE WHEN seq % 19 = 0 THEN 'missing_warc_record_id,' ELSE '' END || CASE WHEN seq % 17 = 0 THEN 'missing_url,' ELSE '' END || CASE WHEN seq % 23 = 0 THEN 'missing_intent,' ELSE '' END
  || CASE WHEN seq % 13 = 0 AND seq % 12 <> 0 THEN 'missing_capture_fidelity,' ELSE '' END || CASE WHEN start_at - 50 >= 0 THEN '' ELSE 'offset,' END || CASE WHEN length % 1000 >= 1 THEN '' ELSE 'length,' END
  || CASE WHEN seq % 8 = 0 THEN 'surface,' ELSE '' END || CASE WHEN seq % 12 = 0 THEN 'capture_fidelity,' ELSE '' END || CASE WHEN seq % 9 = 0 THEN 'observed_at,' ELSE '' END
  || CASE WHEN seq % 10 = 0 AND verdict = 'ok' THEN 'empty_not_ok,' ELSE '' END || CASE WHEN seq % 11 = 0 AND verdict <> 'unknown' THEN 'reason_only_unknown,' ELSE '' END, ',') AS broken FROM {v("captures")} WHERE '{EMPTY_SHA256}' <> ''""",
    "merge_pages": f"""
SELECT route_key, string_agg(CAST(id AS STRING), ',' ORDER BY page, id) AS items, count(DISTINCT CASE WHEN id IS NOT NULL THEN page END) AS pages_with_items FROM {v("items")} GROUP BY route_key""",
    "index_counts": f"""
SELECT 'verdict' AS dimension, verdict AS value, count(*) AS n FROM {v("captures")} GROUP BY verdict UNION ALL
SELECT 'surface', surface, count(*) FROM {v("captures")} GROUP BY surface UNION ALL SELECT 'intent', intent, count(*) FROM {v("captures")} GROUP BY intent""",
    "bundle_summary": f"""
SELECT bundle_id, 'route_key' AS dimension, route_key AS value, count(*) AS captures, CAST(sum(length) AS BIGINT) AS bytes FROM {v("captures")} GROUP BY 1, 3
UNION ALL SELECT bundle_id, 'verdict', verdict, count(*), CAST(sum(length) AS BIGINT) FROM {v("captures")} GROUP BY 1, 3""",
    "items_by_route": f"SELECT route_key, CAST(sum(coalesce(item_count, 1)) AS BIGINT) AS items FROM {v('captures')} WHERE verdict = 'ok' GROUP BY 1",
    "segment_state": f"SELECT segment, count(*) AS records, arg_min(capture_id, seq) AS first_capture_id, arg_max(capture_id, seq) AS last_capture_id FROM {v('captures')} GROUP BY 1",
    "segment_extents": f"SELECT segment, max(start_at + length) AS extent FROM {v('captures')} GROUP BY 1",
    "segment_reconcile": f"""
SELECT coalesce(s.filename, c.segment) AS segment, s.record_count, coalesce(c.n, 0) AS indexed,
       CASE WHEN s.filename IS NULL THEN 'undeclared' WHEN coalesce(c.n, 0) = s.record_count THEN 'ok' WHEN c.n IS NULL THEN 'not_indexed' ELSE 'count_mismatch' END AS status
FROM (SELECT * FROM {v("segments")}) s FULL JOIN (SELECT segment, count(*) AS n FROM {v("captures")} GROUP BY 1) c ON s.filename = c.segment""",
    "version_history": f"SELECT url_key, count(*) AS versions, string_agg(capture_id, ',' ORDER BY observed_at DESC, capture_id DESC) AS captures FROM {v('captures')} GROUP BY 1 HAVING count(*) >= 2",
    "known_captures": f"""
SELECT bucket, url_key, CASE WHEN bucket = 'longform' THEN arg_max(route_key, seq) END AS route_key FROM (
  SELECT *, CASE WHEN route_key = 'interest.item' THEN 'item' WHEN route_key IN ('note.item', 'review.item') THEN 'longform' WHEN route_key LIKE 'asset.%' THEN 'asset' END AS bucket FROM {v("captures")} WHERE verdict = 'ok') x
WHERE bucket IS NOT NULL GROUP BY bucket, url_key""",
    "storage_usage": f"SELECT bundle_id, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files, bool_or(name = 'manifest.json') AS has_manifest, bundle_id <> 'b5' AS deletable FROM {v('files')} GROUP BY bundle_id",
    "frontier_counts": f"""
SELECT s.state, count(f.state) AS n FROM (SELECT unnest(['pending', 'in_flight', 'done', 'failed', 'awaiting_human', 'terminal_stop']) AS state) s LEFT JOIN (SELECT * FROM {v("frontier")}) f ON s.state = f.state GROUP BY s.state""",
    "home_account": "SELECT CAST(c_nationkey AS STRING) AS account_user_id, count(*) AS bundles FROM customer GROUP BY c_nationkey ORDER BY count(*) DESC, min(CASE WHEN c_custkey % 2 = 0 THEN 1000000000 ELSE 0 END + c_custkey) LIMIT 1",
    "coverage_report": f"""
SELECT bundle_id, route_key, CASE WHEN contiguous THEN 'verified' WHEN substr(bundle_id, 4, 1) = '7' THEN 'in_progress' ELSE 'gaps' END AS label, CASE WHEN contiguous THEN 0 ELSE 2 END AS n_gaps FROM {v("state")}""",
    "repeated_captures": f"SELECT capture_id FROM {v('captures')} WHERE bundle_id >= '1997' AND url_key IN (SELECT url_key FROM {v('captures')} WHERE bundle_id < '1997')",
    "frontier_dedup": f"SELECT min(seq) AS seq, url_key FROM {v('frontier')} WHERE url_key NOT IN (SELECT url_key FROM {v('captures')} WHERE verdict = 'ok') GROUP BY url_key",
    "backlog": f"SELECT url_key, count(*) AS times, min(seq) AS first_seq FROM {v('frontier')} WHERE url_key NOT IN (SELECT url_key FROM {v('captures')} WHERE verdict = 'ok') GROUP BY url_key",
    "compare_contents": f"SELECT bundle_id, relation FROM {_RELATION} r",
    "copy_verify": f"""
SELECT coalesce(a.bundle_id || '/' || a.name, b.bundle_id || '/' || b.name) AS name,
       CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'extra' WHEN a.bytes <> b.bytes THEN 'size_mismatch' WHEN a.bytes % 4 = 0 OR b.bytes % 4 = 0 THEN 'size_only' ELSE 'verified' END AS status
FROM (SELECT * FROM {v("files")}) a FULL JOIN {_OTHER} b ON a.bundle_id = b.bundle_id AND a.name = b.name""",
    "declared_files": f"""
SELECT bundle_id, name, code FROM (
  SELECT coalesce(a.bundle_id, b.bundle_id) AS bundle_id, coalesce(a.name, b.name) AS name,
         CASE WHEN a.name IS NOT NULL AND b.name IS NULL THEN 'missing_file' WHEN a.bytes <> b.bytes THEN 'size_mismatch' WHEN a.name IS NULL AND b.name <> 'manifest.json' THEN 'undeclared_file' END AS code
  FROM (SELECT * FROM {v("files")} WHERE name NOT IN ('manifest.json', 'f6')) a FULL JOIN {_OTHER} b ON a.bundle_id = b.bundle_id AND a.name = b.name) x WHERE code IS NOT NULL""",
    "missing_predecessors": f"""
SELECT bundle_id, previous_bundle_id FROM {v("bundles")} WHERE bundle_id % 3 <> 0 AND previous_bundle_id IS NOT NULL
  AND previous_bundle_id NOT IN (SELECT bundle_id FROM {v("bundles")} WHERE bundle_id % 3 <> 0)""",
    "plan_import": f"""
WITH c AS (SELECT o_orderkey AS pos, 'b' || CAST(o_orderkey % 120 AS STRING) AS bundle_id, o_orderkey % 10 = 3 AS other, o_orderkey % 17 = 0 AS fatal FROM orders),
here AS (SELECT DISTINCT bundle_id FROM {_OTHER} o WHERE bundle_id <> 'b8'),
alone AS (SELECT c.pos, c.bundle_id, c.fatal, CASE WHEN c.fatal THEN 'refuse' WHEN c.bundle_id = 'b5' THEN 'active' WHEN c.other THEN 'other_account' WHEN h.bundle_id IS NULL THEN 'import'
            WHEN r.relation = 'same' THEN 'present' WHEN r.relation = 'partial' THEN 'resume' ELSE 'conflict' END AS action
          FROM c LEFT JOIN here h ON c.bundle_id = h.bundle_id LEFT JOIN {_RELATION} r ON c.bundle_id = r.bundle_id),
claims AS (SELECT bundle_id, min(pos) AS at FROM alone WHERE action IN ('import', 'resume') GROUP BY bundle_id)
SELECT a.pos, a.bundle_id, CASE WHEN a.action NOT IN ('refuse', 'active') AND a.pos > k.at THEN 'duplicate' ELSE a.action END AS action FROM alone a LEFT JOIN claims k ON a.bundle_id = k.bundle_id""",
    "chain_holes": f"""
SELECT bundle_id, route_key, floor_from_bundle_id, hole FROM (
  SELECT s.bundle_id, s.route_key, s.floor_from_bundle_id, CASE WHEN f.bundle_id IS NULL THEN 'absent' WHEN f.high_water_time IS DISTINCT FROM s.floor_time THEN 'mismatch' END AS hole
  FROM (SELECT * FROM {v("state")}) s LEFT JOIN (SELECT * FROM {v("state")}) f ON s.floor_from_bundle_id = f.bundle_id AND s.route_key = f.route_key WHERE s.floor_from_bundle_id IS NOT NULL) x WHERE hole IS NOT NULL""",
    "stall_detection": f"SELECT route_key, page, n_ids, new_ids, duplicates, CAST(barren AS BIGINT) AS barren, CAST(empties AS BIGINT) AS empties, stalled FROM {_STALLS}",
    "route_termination": f"""
SELECT route_key, page, CASE WHEN page = stop THEN why END AS end_reason FROM (
  SELECT *, min(CASE WHEN why IS NOT NULL THEN page END) OVER (PARTITION BY route_key) AS stop FROM (
    SELECT s.route_key, s.page, CASE WHEN f.low <= 20 THEN 'reached_floor' WHEN s.stalled THEN 'stalled' WHEN s.page >= 30 THEN 'last_page' END AS why
    FROM {_STALLS.removesuffix(' stalls')} s JOIN (SELECT route_key, page, min(ts) AS low FROM {v("items")} GROUP BY 1, 2) f ON s.route_key = f.route_key AND s.page = f.page) a) b WHERE stop IS NULL OR page <= stop""",
    "size_anomaly": f"""
SELECT capture_id, CAST(n AS INTEGER) AS n_before, med AS median_before, coalesce(n >= 8 AND length / med < 0.25, false) AS anomalous FROM (
  SELECT capture_id, length, count(*) OVER w AS n, median(length) OVER w AS med FROM (
    SELECT seq, capture_id, route_key || '/' || bundle_id AS r, CASE WHEN seq % 50 = 0 THEN length % 500 ELSE length END AS length FROM {v("captures")} WHERE verdict = 'ok') x
  WINDOW w AS (PARTITION BY r ORDER BY seq ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING)) y""",
    "route_watermarks": f"""
SELECT m.route_key, m.high, m.low, coalesce(string_agg(CAST(e.id AS STRING), ',' ORDER BY e.first), '') AS high_ids
FROM (SELECT route_key, max(ts) AS high, min(ts) AS low FROM {v("items")} WHERE ts IS NOT NULL GROUP BY 1) m
LEFT JOIN (SELECT route_key, ts, id, min(pos) AS first FROM {v("items")} WHERE id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2, 3) e ON m.route_key = e.route_key AND m.high = e.ts GROUP BY 1, 2, 3""",
    "item_time_range": f"""
SELECT route_key, page, first(raw ORDER BY t, pos) AS oldest, first(raw ORDER BY t DESC, pos) AS newest FROM (
  SELECT route_key, page, pos, ts // 10 AS t, strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(ts // 10 + CASE WHEN event_id % 2 = 1 THEN 480 ELSE 0 END AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 1 THEN '+08:00' ELSE 'Z' END AS raw
  FROM {v("items")} WHERE ts IS NOT NULL AND event_id % 11 <> 0) x GROUP BY 1, 2""",
    "progress_marker": f"""
SELECT route_key, page, page_median, min(page_median) OVER (PARTITION BY route_key ORDER BY page) AS progress FROM (
  SELECT route_key, page, list_sort(list(ts))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS page_median FROM {v("items")} WHERE ts IS NOT NULL GROUP BY 1, 2) x""",
    "floor_filter": f"""
SELECT i.event_id, coalesce(i.ts <= f.low + 100, false) AS below_floor FROM (SELECT * FROM {v("items")}) i
LEFT JOIN (SELECT route_key, min(ts) AS low FROM {v("items")} WHERE route_key < 'p' GROUP BY 1) f ON i.route_key = f.route_key""",
    "event_rings": f"""
SELECT event_id, ring FROM (SELECT event_id, ring, row_number() OVER (PARTITION BY ring ORDER BY t DESC, event_id DESC) AS turn FROM (
  SELECT event_id, coalesce(ts, 0) AS t, CASE WHEN event_id % 3 = 0 THEN 'small' ELSE 'large' END AS ring FROM {v("items")}) a) b WHERE turn <= CASE ring WHEN 'small' THEN 200 ELSE 1000 END""",
    "network_down": f"""
SELECT event_id, CAST(run AS BIGINT) AS run, run >= 6 AS down FROM (
  SELECT event_id, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY route_key, island ORDER BY pos) AS run FROM (
    SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY route_key ORDER BY pos) AS island FROM (SELECT *, event_id * 13 % 10 < 7 AS failed FROM {v("items")}) a) b) c""",
    "capture_lineage": f"""
SELECT capture_id, CASE WHEN seq % 5 = 3 THEN 'given' WHEN seq % 6 = 0 THEN NULL ELSE lag(capture_id) OVER (PARTITION BY route_key, bundle_id ORDER BY seq) END AS parent FROM {v("captures")}""",
    "frontier_next": f"""
WITH f AS (SELECT * FROM {v("frontier")})
SELECT seq, url_key FROM f WHERE state = 'pending' AND gate_open
  AND route_key NOT IN (SELECT route_key FROM f WHERE state IN ('in_flight', 'awaiting_human') OR (state = 'failed' AND ordered))
ORDER BY priority, CASE WHEN route_key IN (SELECT route_key FROM f WHERE state = 'done' AND seq % 11 = 0) THEN 0 ELSE 1 END, seq LIMIT 50""",
    "replay_list": f"SELECT capture_id FROM {v('captures')} WHERE seq > 100 AND verdict = 'ok' ORDER BY seq DESC LIMIT 100",
    "pick_floors": f"""
SELECT route_key, bundle_id AS floor_from_bundle_id, high_water_time AS floor_time FROM (
  SELECT *, row_number() OVER (PARTITION BY route_key ORDER BY bundle_id DESC) AS turn FROM {v("state")} WHERE advanced) x WHERE turn = 1""",
    "chain_walk": _WALK.format(bundles=v("bundles"), starts="WHERE time_key >= 2") + " SELECT head, bundle_id, depth FROM walk",
    "chain_heads": _WALK.format(bundles=v("bundles"), starts="") + """
SELECT bundle_id FROM b WHERE bundle_id NOT IN (SELECT w.bundle_id FROM walk w JOIN b h ON w.head = h.bundle_id JOIN b t ON w.bundle_id = t.bundle_id
  WHERE h.time_key > t.time_key OR (h.time_key = t.time_key AND h.bundle_id > t.bundle_id))""",
    "chain_coverage": f"""
WITH RECURSIVE s AS (SELECT * FROM {v("state")}),
proof AS (
  SELECT s.route_key, s.bundle_id, s.contiguous, s.floor_time, s.floor_from_bundle_id AS source FROM s JOIN (SELECT route_key, min(pos) AS pos FROM s GROUP BY 1) f ON s.route_key = f.route_key AND s.pos = f.pos
  UNION SELECT s.route_key, s.bundle_id, s.contiguous, s.floor_time, s.floor_from_bundle_id FROM proof p JOIN s ON p.source = s.bundle_id AND p.route_key = s.route_key WHERE p.contiguous AND p.floor_time IS NOT NULL),
holes AS (SELECT s.route_key, count(*) AS holes FROM s LEFT JOIN s f ON s.floor_from_bundle_id = f.bundle_id AND s.route_key = f.route_key
          WHERE s.floor_from_bundle_id IS NOT NULL AND f.high_water_time IS DISTINCT FROM s.floor_time GROUP BY 1),
total AS (SELECT route_key, max(high_water_time) AS newest, min(low_water_time) AS oldest, string_agg(bundle_id, ',' ORDER BY pos) AS bundles, CAST(sum(CASE WHEN contiguous THEN 0 ELSE 1 END) AS INTEGER) AS n_gaps FROM s GROUP BY 1)
SELECT t.route_key, t.newest, t.oldest, t.bundles, t.route_key IN (SELECT route_key FROM proof WHERE contiguous AND floor_time IS NULL) AND coalesce(h.holes, 0) = 0 AS contiguous, coalesce(h.holes, 0) AS holes, t.n_gaps
FROM total t LEFT JOIN holes h ON t.route_key = h.route_key""",
    "warc_roundtrip": "SELECT page_id, url, CAST(strlen(html) AS INTEGER) AS bytes, sha256(html) AS sha256 FROM pages",
    "stream_event_window": "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "asset_verdict": """
SELECT page_id, CASE WHEN html_ AND empty THEN 'unknown' WHEN st = 403 THEN 'blocked' WHEN st = 404 THEN 'gone' WHEN st <> 200 THEN 'unknown' WHEN html_ THEN 'login' WHEN empty THEN 'unknown' WHEN image THEN 'ok' ELSE 'unknown' END AS verdict,
       CASE WHEN html_ AND empty THEN 'empty_body' WHEN st IN (403, 404) THEN NULL WHEN st <> 200 THEN CASE WHEN html_ THEN 'server_error' ELSE 'unexpected_status' END WHEN html_ THEN NULL WHEN empty THEN 'empty_body' WHEN image THEN NULL ELSE 'not_an_image' END AS verdict_reason
FROM (SELECT page_id, CASE page_id % 7 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 500 ELSE 200 END AS st, page_id % 5 = 1 AS html_, page_id % 4 = 1 AS empty, page_id % 5 = 2 OR page_id % 4 = 2 AS image FROM pages) x""",
    "event_routing": f"SELECT seq, seq % 3 <> 0 AS logged, seq % 3 <> 0 AND seq % 5 <> 0 AND verdict = 'ok' AS routine FROM {v('captures')}",
    "renamed_bundles": "SELECT c_custkey AS bundle_id, 'old' AS was FROM customer WHERE c_nationkey = 3 AND c_custkey % 3 = 0",
    "prerequisites": """
SELECT n_nationkey, waiting_for, waiting_for = '' AS ready FROM (
  SELECT n_nationkey, trim(CASE WHEN n_nationkey % 5 IN (1, 4) THEN '' ELSE CAST(n_nationkey % 5 AS STRING) END || ',' || CASE WHEN n_nationkey % 3 = 1 THEN '' ELSE CAST(n_nationkey % 3 AS STRING) END, ',') AS waiting_for FROM nation) x""",
    "error_classes": """
SELECT o_orderkey, CASE WHEN k IN (0, 1) THEN CASE WHEN o_orderkey % 2 = 0 THEN 'timeout' ELSE 'aborted' END WHEN k = 2 THEN 'network' ELSE 'unknown' END AS transport,
       CASE WHEN k = 3 OR o_orderkey % 30 = 22 OR o_orderkey % 7 = 0 THEN 'quota' ELSE 'write_failed' END AS write FROM (SELECT o_orderkey, o_orderkey % 5 AS k FROM orders) x""",
    "account_mismatch": """
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 'id 7 -> 8' WHEN c_custkey % 4 <> 0 AND c_custkey % 7 = 0 THEN 'name ann -> bob' END AS mismatch FROM customer""",
    "storage_preflight": """
SELECT o_orderkey, CASE WHEN quota > 0 THEN greatest(0, quota - o_custkey * 1000) END AS available, CASE WHEN quota > 0 THEN greatest(0, quota - o_custkey * 1000) >= 300000 END AS enough
FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) * 5 END AS quota FROM orders) x""",
    "nonok_tally": f"SELECT route_key, verdict, count(*) AS n FROM {v('captures')} WHERE verdict <> 'ok' GROUP BY 1, 2",
    "gate_waits": f"""
SELECT event_id, CAST(greatest(0, 1000 - coalesce(pos * 700 - lag(pos * 700 + event_id % 500) OVER (PARTITION BY route_key ORDER BY pos), 1000)) AS BIGINT) AS wait_ms FROM {v("items")}""",
    "idle_batches": f"""
SELECT event_id, CAST(idle AS BIGINT) AS idle, idle >= 3 AS stalled FROM (
  SELECT event_id, sum(CASE WHEN still THEN 1 ELSE 0 END) OVER (PARTITION BY route_key, island ORDER BY pos) AS idle FROM (
    SELECT *, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER (PARTITION BY route_key ORDER BY pos) AS island FROM (SELECT *, event_id * 7 % 10 >= 4 AS still FROM {v("items")}) a) b) c""",
    "derived_captures": f"""
WITH c AS (SELECT * FROM {v("captures")})
SELECT a.capture_id, a.parent AS parent_capture_id, p.route_key AS parent_route
FROM (SELECT capture_id, bundle_id || '#' || lpad(CAST(seq - 1 AS STRING), 9, '0') AS parent FROM c WHERE seq % 3 = 1) a LEFT JOIN c p ON a.parent = p.capture_id""",
    "latest_values": f"SELECT key, value FROM (SELECT url_key AS key, CASE WHEN seq % 10 <> 0 THEN capture_id END AS value, row_number() OVER (PARTITION BY url_key ORDER BY seq DESC) AS turn FROM {v('captures')}) x WHERE turn = 1 AND value IS NOT NULL",
    "deletion_candidates": f"""
SELECT DISTINCT route_key, url_key AS id FROM {v("captures")} WHERE bundle_id = '1996' AND route_key = 'interest.item'
  AND url_key NOT IN (SELECT url_key FROM {v("captures")} WHERE bundle_id = '1997' AND route_key = 'interest.item')""",
    "status_photos": """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'r' || CAST(p_partkey AS STRING) || ',l' || CAST(p_partkey AS STRING) || ',z' ELSE 'z' END AS urls,
       CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS skipped_others, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS unresolved FROM part""",
    "generated_urls": """
SELECT n_nationkey, CAST(k * 15 AS INTEGER) AS "offset", '/list/' || CAST(n_nationkey AS STRING) || '?start=' || CAST(k * 15 AS STRING) AS url FROM nation, (SELECT unnest(range(0, 30)) AS k) s WHERE k * 15 <= n_nationkey * 10""",
    "stream_route_state": f"""
WITH g AS (SELECT route_key, page, kind, count(*) AS n, max(ts) AS top, min(ts) AS bottom, count(DISTINCT id) AS ids, count(CASE WHEN ts IS NULL AND raw <> '' THEN 1 END) AS unread FROM {v("run_rows")} GROUP BY 1, 2, 3),
s AS (SELECT *, coalesce(sum(CASE WHEN kind = 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY route_key ORDER BY page, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM g),
runs AS (SELECT route_key, run, bool_or(kind = 'end') AS ended, max(CASE WHEN kind = 'page' THEN top END) AS pending, sum(CASE kind WHEN 'gap' THEN n WHEN 'page' THEN unread ELSE 0 END) AS gaps FROM s GROUP BY 1, 2),
high AS (SELECT route_key, max(CASE WHEN ended AND gaps = 0 THEN pending END) AS high_water, max(CASE WHEN NOT ended THEN pending END) AS pending_high, coalesce(max(CASE WHEN NOT ended THEN gaps END), 0) AS gaps FROM runs GROUP BY 1),
fresh AS (SELECT route_key, page, count(*) AS n FROM (SELECT route_key, id, min(page) AS page FROM {v("run_rows")} WHERE kind = 'page' AND id IS NOT NULL GROUP BY 1, 2) f GROUP BY 1, 2),
p AS (SELECT g.route_key, g.page, g.ids, coalesce(f.n, 0) AS fresh, g.bottom, row_number() OVER (PARTITION BY g.route_key ORDER BY g.page) AS k FROM g LEFT JOIN fresh f ON g.route_key = f.route_key AND g.page = f.page WHERE kind = 'page'),
r AS (SELECT *, k - max(CASE WHEN fresh > 0 THEN k ELSE 0 END) OVER w AS barren, k - max(CASE WHEN ids > 0 THEN k ELSE 0 END) OVER w AS empties FROM p WINDOW w AS (PARTITION BY route_key ORDER BY page)),
t AS (SELECT route_key, min(bottom) AS low_water, count(*) AS pages, CAST(sum(ids) AS BIGINT) AS items, bool_or(barren >= 3 OR empties >= 2) AS stalled FROM r GROUP BY 1)
SELECT h.route_key, h.high_water, h.pending_high, t.low_water, CAST(h.gaps AS INTEGER) AS gaps, coalesce(t.pages, 0) AS pages, coalesce(t.items, 0) AS items, coalesce(t.stalled, false) AS stalled FROM high h LEFT JOIN t ON h.route_key = t.route_key""",
    "stream_write_once": "SELECT event_id, event_type FROM events",
    "url_tokens": r"""
WITH u AS (SELECT page_id, page_id % 4 IN (0, 2) AS tracking, CASE WHEN page_id % 7 = 0 THEN 'no url' ELSE url || CASE page_id % 3 WHEN 0 THEN '?ck=1' WHEN 1 THEN '?a=1' ELSE '' END END AS u FROM pages)
SELECT page_id, tracking, CASE WHEN contains(u, '?ck=') OR contains(u, '&ck=') THEN u ELSE u || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 'ck=t' END AS with_token,
       lower(regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1)) IN ('example.com', 'example.net') AS shortlink FROM u""",
    "digest_fields": "SELECT doc_id, sha256(text) AS text, sha256(source) AS source FROM documents",
    "bundle_names": r"""
WITH b AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 9 = 0 THEN 'odd' ELSE strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '-' || lpad(lower(hex(o_orderkey)), 6, '0') END AS id FROM orders),
s AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'data' ELSE 'assets' END AS kind, o_orderkey * 50 AS number FROM b)
SELECT o_orderkey, id AS bundle_id, id <> 'odd' AS valid, CASE WHEN id <> 'odd' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN id <> 'odd' THEN id END AS from_directory, 'index-' || id || '.ndjson' AS index_file,
       kind || '-' || id || '-' || CASE WHEN number < 100000 THEN lpad(CAST(number AS STRING), 5, '0') ELSE CAST(number AS STRING) END || '.warc.gz' AS segment, CAST(number AS BIGINT) AS number, kind FROM s""",
    "decoded_entities": r"""SELECT p_partkey, '&lt; ' || p_name || ' <AB> &odd; "' || CAST(p_partkey AS STRING) || '" & &#0;' AS decoded FROM part""",
    "capture_labels": f"""
SELECT seq, lpad(CAST(seq AS STRING), 9, '0') AS short_id, observed_at || CASE WHEN seq % 5 = 0 THEN '?' ELSE ' 10:20' END AS human_time,
       route_key || ' / ' || CASE seq % 3 WHEN 0 THEN 'page ' || CAST(seq AS STRING) WHEN 1 THEN 'from ' || CAST(seq AS STRING) ELSE url_key END AS title,
       CASE WHEN item_count IS NULL THEN '' WHEN item_count = 0 THEN '0 items (the end) / ' ELSE CAST(item_count AS STRING) || ' items / ' END
         || CASE WHEN seq % 7 <> 0 THEN observed_at ELSE 'fetched ' || observed_at || 'T05:06:07' || CASE WHEN seq % 2 = 0 THEN '' ELSE ' (no item times in this archive)' END END AS subtitle,
       CASE WHEN seq % 2 = 0 THEN 'Book ' ELSE 'Film ' END || CAST(seq AS STRING) AS subject FROM {v("captures")}""",
    "state_labels": """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '5-LOW' THEN 'Low' ELSE o_orderpriority END AS name,
       CASE WHEN o_orderkey % 4 = 0 THEN 'verified' WHEN o_orderkey % 3 <> 0 THEN 'in progress' WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 5 AS STRING) || ' gaps' ELSE 'not finished' END AS contiguity,
       CASE o_orderkey % 3 WHEN 0 THEN 'no finished archive' WHEN 1 THEN 'one archive, nothing incremental yet' ELSE '2 archives, from the newest back' END AS headline FROM orders""",
    "offset_times": r"""
WITH t AS (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS moment FROM orders)
SELECT o_orderkey, strftime(moment + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+08:00') AS local, strftime(moment - INTERVAL 210 MINUTE, '%Y-%m-%dT%H:%M:%S-03:30') AS west, strftime(moment, '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
       CASE WHEN o_orderkey % 3 = 0 THEN epoch_ms(moment) WHEN o_orderkey % 2 = 0 THEN 1704164645000 ELSE 0 END AS time_key FROM t""",
    "same_account": """
SELECT c_custkey, coalesce(u = '1', false) AND coalesce(n = '0', false) AS "both", coalesce(u = '1', false) AS by_id, coalesce(n = '0', false) AS by_name, true AS "any"
FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 3 AS STRING) END AS u, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 2 AS STRING) END AS n FROM customer) c""",
    "derives_work": f"SELECT seq, seq % 4 = 0 OR starts_with(route_key, 'interest.') AS derives FROM {v('captures')}",
    "claimed_counts": """
SELECT p_partkey, CASE WHEN p_partkey % 5 > 1 THEN p_partkey * 3 END AS claimed, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '<h1>' || p_name || ' (many)</h1>' ELSE '<h1>' || p_name || ' (' || CAST(p_partkey * 3 AS STRING) || ')</h1>' END AS raw FROM part""",
    "paginations": """
SELECT p_partkey, CASE WHEN ok THEN CAST(p_partkey % 4 AS STRING) END AS page, CASE WHEN ok THEN CASE WHEN p_partkey % 7 = 0 THEN '9223372036854775808' ELSE CAST(p_partkey % 6 AS STRING) END END AS total_pages
FROM (SELECT p_partkey, p_partkey % 11 <> 0 AND p_partkey % 4 > 0 AND (p_partkey % 7 = 0 OR p_partkey % 6 > 0) AS ok FROM part) x""",
    "cover_images": """
SELECT p_partkey, CASE WHEN reason = 'ok' THEN 'c' || CAST(p_partkey AS STRING) END AS url, reason
FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 4 = 3 THEN 'not_found' WHEN p_partkey % 3 = 0 THEN 'placeholder' ELSE 'ok' END AS reason FROM part) x""",
    "embedded_images": "SELECT p_partkey, CAST(p_partkey AS STRING) || ',b' AS urls, p_name || ',' AS captions FROM part",
    "render_sample": f"""
SELECT route_key, count(*) AS pages, CAST(sum(CASE WHEN seq % 5 = 0 OR verdict <> 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS failures
FROM (SELECT *, row_number() OVER (PARTITION BY route_key ORDER BY seq) AS turn FROM {v("captures")}) c WHERE turn <= 30 GROUP BY 1""",
    "extracted_rows": """
SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 2 = 0 THEN '2024-01-01' END AS date, CAST(CASE WHEN p_partkey % 7 <> 0 THEN 2 END AS INTEGER) AS n_tags, CAST(NULL AS STRING) AS comment FROM part""",
    "verification": f"""
WITH problems AS (SELECT count(*) AS n FROM (SELECT * FROM {v("files")}) a FULL JOIN {_OTHER} b ON a.bundle_id = b.bundle_id AND a.name = b.name
                  WHERE (b.name IS NULL) OR (a.name IS NOT NULL AND a.bytes <> b.bytes) OR (a.name IS NULL AND b.name NOT IN ('manifest.json', 'README.txt', 'checkpoint.json')))
SELECT problems.n + f.n AS checked, CAST(f.n AS BIGINT) AS ok, CAST(problems.n AS BIGINT) AS problems FROM problems, (SELECT count(*) AS n FROM {v("files")}) f""",
    "export_state": f"SELECT bundle_id, CASE WHEN CAST(substr(bundle_id, 2) AS INTEGER) IN (SELECT n_nationkey FROM nation) THEN 'exported' ELSE 'not_exported' END AS export_state FROM {v('files')} GROUP BY 1",
    "bundle_sizes": f"""
WITH d AS (SELECT bundle_id, sum(bytes) AS bytes FROM (SELECT bundle_id, segment, max(start_at + length) AS bytes FROM {v("captures")} WHERE bundle_id < '1995' GROUP BY 1, 2) s GROUP BY 1)
SELECT c.bundle_id, c.captures, CAST(coalesce(d.bytes, c.bytes) AS BIGINT) AS total_bytes, d.bytes IS NOT NULL AS exact FROM (SELECT bundle_id, count(*) AS captures, sum(length) AS bytes FROM {v("captures")} GROUP BY 1) c LEFT JOIN d ON c.bundle_id = d.bundle_id""",
    "segment_numbers": f"""
SELECT CASE WHEN seq % 2 = 0 THEN 'data' ELSE 'assets' END AS kind, count(DISTINCT bundle_id || '/' || CAST(seq % 300 AS STRING)) AS segments, CAST(max(seq % 300) AS BIGINT) AS highest FROM {v("captures")} WHERE seq % 7 <> 0 GROUP BY 1""",
    "page_floors": f"""
WITH f AS (SELECT route_key, min(ts) + 50 AS floor FROM {v("items")} WHERE length(route_key) % 2 = 0 GROUP BY 1)
SELECT i.route_key, i.page, coalesce(bool_or(i.ts <= f.floor), false) AS reached_floor, CAST(sum(CASE WHEN i.ts IS NULL AND i.event_id % 18 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unparsable FROM (SELECT * FROM {v("items")}) i LEFT JOIN f ON i.route_key = f.route_key GROUP BY 1, 2""",
    "replay_truncated": f"SELECT greatest(0, count(*) - 100) AS truncated FROM {v('captures')} WHERE seq > 100 AND verdict = 'ok'",
    "opened_gates": f"""
WITH f AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'r' || CAST(seq % 40 AS STRING) END AS gate FROM {v("frontier")}),
open AS (SELECT route_key FROM f GROUP BY 1 HAVING CAST(substr(route_key, 2) AS INTEGER) % 2 = 0 AND NOT bool_or(state = 'pending' AND route_key NOT IN ('r2', 'r4', 'r6')))
SELECT seq, gate IS NULL OR gate IN (SELECT route_key FROM open) AS gate_open FROM f""",
    "list_limits": f"""
SELECT 'rows' AS what, name FROM (SELECT capture_id AS name FROM {v("captures")} ORDER BY 1 LIMIT 500) a UNION ALL SELECT 'bad_rows', name FROM (SELECT capture_id AS name FROM {v("captures")} WHERE verdict <> 'ok' ORDER BY 1 LIMIT 100) b
UNION ALL SELECT 'routes', name FROM (SELECT DISTINCT route_key AS name FROM {v("frontier")} ORDER BY 1 LIMIT 40) c""",
    "within_budget": f"""
SELECT event_id, spent_ms FROM (SELECT event_id, CAST(coalesce(sum(event_id % 5000) OVER (PARTITION BY route_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_ms FROM {v("items")}) x WHERE spent_ms < 22000""",
    "route_order": """
WITH media(m) AS (VALUES ('movie'), ('book'), ('music'), ('game'), ('drama')), states(s) AS (VALUES ('collect'), ('wish'), ('do')),
rows_(priority, key, intent, kind, surface, enumeration, ordered) AS (
  SELECT 0, 'profile.overview', 'profile.overview', 'data', 'html', 'full', CAST(NULL AS BOOLEAN) UNION ALL SELECT 0, 'profile.category_entry.' || m, 'profile.category_entry.' || m, 'data', 'html', 'full', NULL FROM media
  UNION ALL SELECT 40, 'interest.' || m || '.' || s, 'interest.list.' || m || '.' || s, 'data', 'html', 'full', NULL FROM media, states WHERE m <> 'drama' OR s <> 'do'
  UNION ALL SELECT * FROM (VALUES (10, 'broadcast.timeline', 'broadcast.timeline', 'data', 'html', 'bounded', NULL), (30, 'asset.status_photo', 'asset.image.user_upload', 'assets', 'asset', 'bounded', false),
    (30, 'asset.longform_embed', 'asset.image.user_upload', 'assets', 'asset', 'bounded', false), (20, 'note.list', 'note.list', 'data', 'html', 'full', NULL), (20, 'review.list', 'review.list', 'data', 'html', 'full', NULL),
    (21, 'note.item', 'note.item', 'data', 'html', 'full', false), (21, 'review.item', 'review.item', 'data', 'html', 'full', false), (22, 'doulist.list', 'doulist.list.created', 'data', 'html', 'full', NULL),
    (23, 'doulist.item', 'doulist.item', 'data', 'html', 'full', NULL), (90, 'interest.item', 'interest.item', 'catalog', 'html', 'full', false), (91, 'asset.subject_cover', 'asset.image.catalog_thumbnail', 'catalog', 'asset', 'full', false)) t)
SELECT CAST(row_number() OVER (ORDER BY priority, key) AS INTEGER) AS turn, key, intent, kind, surface, enumeration, ordered FROM rows_""",
    "seeded_frontier": """
WITH m(m, host, tail) AS (VALUES ('movie', 'movie', ''), ('book', 'book', ''), ('music', 'music', ''), ('game', 'www', 'games'), ('drama', 'www', '')),
s(s) AS (VALUES ('collect'), ('wish'), ('do')),
x AS (
  SELECT 'profile.category_entry.' || m AS route_key, 'https://' || host || '.example.com/' || CASE WHEN m = 'drama' THEN 'location/people/some%20one/drama/' ELSE 'people/some%20one/' || tail END AS url, '' AS query, '' AS sorted, 0 AS priority, NULL AS cursor_kind, NULL AS cursor_value FROM m
  UNION ALL SELECT 'interest.' || m || '.' || s, CASE m WHEN 'game' THEN 'https://www.example.com/people/some%20one/games' WHEN 'drama' THEN 'https://www.example.com/location/people/some%20one/drama/' || s ELSE 'https://' || host || '.example.com/people/some%20one/' || s END,
    CASE m WHEN 'game' THEN '?action=' || s || '&start=0' WHEN 'drama' THEN '?sort=time&start=0&filter=all&mode=grid&tags_sort=count' WHEN 'movie' THEN '?start=0&sort=time&rating=all&mode=grid&type=all&filter=all' ELSE '?start=0&sort=time&rating=all&filter=all&mode=grid' END,
    CASE m WHEN 'game' THEN '?action=' || s || '&start=0' WHEN 'drama' THEN '?filter=all&mode=grid&sort=time&start=0&tags_sort=count' WHEN 'movie' THEN '?filter=all&mode=grid&rating=all&sort=time&start=0&type=all' ELSE '?filter=all&mode=grid&rating=all&sort=time&start=0' END, 40, 'start', 0 FROM m, s WHERE m <> 'drama' OR s <> 'do'
  UNION ALL SELECT 'profile.overview', 'https://www.example.com/people/some%20one/', '', '', 0, NULL, NULL UNION ALL SELECT 'broadcast.timeline', 'https://www.example.com/people/some%20one/statuses', '?p=1', '?p=1', 10, 'page', 1
  UNION ALL SELECT 'note.list', 'https://www.example.com/people/some%20one/notes', '?start=0', '?start=0', 20, 'start', 0 UNION ALL SELECT 'review.list', 'https://www.example.com/people/some%20one/reviews', '?start=0', '?start=0', 20, 'start', 0
  UNION ALL SELECT 'doulist.list', 'https://www.example.com/people/some%20one/doulists/all', '?start=0', '?start=0', 22, 'start', 0)
SELECT route_key, url || query AS url, url || sorted AS url_key, cursor_kind IS NOT NULL AS ordered, CAST(priority AS INTEGER) AS priority, cursor_kind, CAST(cursor_value AS INTEGER) AS cursor_value FROM x""",
    "capture_write": """
SELECT page_id AS seq, '20240102T030405Z-00ff00#' || CASE WHEN page_id < 1000000 THEN lpad(CAST(page_id AS STRING), 6, '0') ELSE CAST(page_id AS STRING) END AS capture_id, url, 'v1' AS url_key_rules, 'page' AS intent, 'r' || CAST(page_id % 3 AS STRING) AS route_key,
       CASE WHEN page_id % 5 = 0 THEN 'gone' ELSE 'ok' END AS verdict, 'decoded_body+observed_headers' AS capture_fidelity, strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS observed_at, CAST(200 + page_id % 3 AS INTEGER) AS http_status,
       'text/html' AS content_type, sha256(html) AS content_sha256, CAST(page_id % 20 AS INTEGER) AS item_count, page_id AS cursor_value, CASE WHEN page_id % 4 = 0 THEN 'assets' ELSE 'data' END AS kind, CASE WHEN html = '' AND page_id % 5 > 0 THEN 'empty_not_ok' ELSE '' END AS broken,
       strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
       'sha1:' || list_aggregate(list_transform(range(0, 40, 5), lambda i: list_aggregate(list_transform(range(0, 4), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha1(html), CAST(i + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * k AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       'HTTP/1.1 ' || CAST(200 + page_id % 3 AS STRING) AS status_line, CAST(page_id AS STRING) || ',again' AS x_id, CAST(strlen(html) AS INTEGER) AS bytes FROM pages""",
    "segment_heads": "SELECT DISTINCT CASE WHEN page_id % 4 = 0 THEN 'assets' ELSE 'data' END AS kind, 'warcinfo' AS warc_type, true AS named, '20240102T030405Z-00ff00' AS part_of, 'WARC File Format 1.1' AS format FROM pages",
    "segment_descriptors": """
SELECT CASE WHEN page_id % 4 = 0 THEN 'assets' ELSE 'data' END AS kind, count(*) AS records, min(id) AS first_capture_id, max(id) AS last_capture_id, true AS whole
FROM (SELECT page_id, '20240102T030405Z-00ff00#' || lpad(CAST(page_id AS STRING), 6, '0') AS id FROM pages) p GROUP BY 1""",
    "index_recount": """
WITH c AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'gone' ELSE 'ok' END AS verdict FROM pages),
n AS (SELECT 'verdict' AS dimension, verdict AS value, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'surface', 'html', count(*) FROM c UNION ALL SELECT 'intent', 'page', count(*) FROM c)
SELECT *, 'strict' AS reading FROM n UNION ALL SELECT *, 'lenient' FROM n UNION ALL SELECT 'broken', 'lines', count(*), 'lenient' FROM c WHERE verdict = 'gone'""",
    "manifest_roundtrip": f"""
WITH c AS (SELECT bundle_id, count(DISTINCT segment) AS segments, CAST(count(*) AS BIGINT) AS records, min(capture_id) AS first_capture_id FROM {v("captures")} GROUP BY 1),
s AS (SELECT bundle_id, count(*) AS runs, CAST(sum(CASE WHEN contiguous THEN 1 ELSE 0 END) AS BIGINT) AS contiguous, count(DISTINCT route_key) AS covered FROM {v("state")} GROUP BY 1)
SELECT c.*, s.runs, s.contiguous, s.covered, CAST(0 AS INTEGER) AS broken FROM c JOIN s ON c.bundle_id = s.bundle_id""",
    "manifest_cross_check": f"""
SELECT coalesce(s.filename, c.segment) AS filename, s.record_count, coalesce(c.n, 0) AS indexed, CASE WHEN s.filename IS NULL THEN 'undeclared' ELSE 'count_mismatch' END AS problem
FROM (SELECT * FROM {v("segments")}) s FULL JOIN (SELECT segment, count(*) AS n FROM {v("captures")} GROUP BY 1) c ON s.filename = c.segment WHERE s.record_count IS DISTINCT FROM coalesce(c.n, 0)""",
    "recovery_plan": f"""
WITH e AS (SELECT segment || '.warc.gz' AS name, max(start_at + length) AS extent, CAST(substr(segment, 6, 1) AS INTEGER) AS n FROM {v("captures")} GROUP BY segment)
SELECT name, CASE n WHEN 1 THEN 'truncate' ELSE 'fatal' END AS action, extent AS keep_bytes FROM e WHERE n IN (1, 2) UNION ALL SELECT 'lost.warc.gz', 'delete', 0 FROM e WHERE n = 3""",
    "bundle_discovery": """
SELECT array_to_string(list_transform(range(0, k % 5 + 1), lambda i: 'd' || CAST(k AS STRING)), '/') AS directory, CAST(k % 5 + 1 AS INTEGER) AS depth FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey < 10) n WHERE k % 5 < 3""",
    "identity_conflicts": """
SELECT 'd' || CAST(o_orderkey % 500 AS STRING) AS directory, CAST(count(DISTINCT CASE WHEN o_orderkey % 1700 = 0 THEN -1 ELSE o_orderkey % 500 END) AS INTEGER) AS ids FROM orders GROUP BY 1 HAVING count(DISTINCT CASE WHEN o_orderkey % 1700 = 0 THEN -1 ELSE o_orderkey % 500 END) > 1""",
    "import_totals": "SELECT a.action, count(*) AS bundles, CAST(sum(floor(o.o_totalprice)) AS BIGINT) AS bytes FROM (%PLAN%) a JOIN orders o ON a.pos = o.o_orderkey WHERE a.action IN ('import', 'resume') GROUP BY 1",
}
ORACLES["import_totals"] = ORACLES["import_totals"].replace("%PLAN%", ORACLES["plan_import"])

"""The driver's tables in the shape of archive tables. Each text is plain SQL that Spark and DuckDB read alike, so that oracles see the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

ADAPTERS = {
    # one capture an order
    "captures": """
SELECT CAST(o_orderkey AS BIGINT) AS seq, CAST(year(o_orderdate) AS STRING) AS bundle_id,
       CAST(year(o_orderdate) AS STRING) || '#' || lpad(CAST(o_orderkey AS STRING), 9, '0') AS capture_id,
       'data-' || CAST(o_orderkey % 7 AS STRING) AS segment, CAST(o_orderkey * 10 AS BIGINT) AS start_at, CAST(floor(o_totalprice) AS BIGINT) AS length,
       'k' || CAST(o_custkey AS STRING) AS url_key,
       CASE o_orderkey % 5 WHEN 0 THEN 'interest.item' WHEN 1 THEN 'note.item' WHEN 2 THEN 'review.item' WHEN 3 THEN 'asset.cover' ELSE 'list' END AS route_key,
       CASE o_orderkey % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'api' ELSE 'asset' END AS surface,
       CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'unknown' ELSE 'gone' END AS verdict,
       o_orderpriority AS intent, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS INTEGER) END AS item_count,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS observed_at
FROM {orders}""",
    # items on pages of five, of routes that are an event type and day
    "items": """
SELECT route_key, CAST(floor((rn - 1) / 5.0) AS BIGINT) AS page, CAST(rn AS BIGINT) AS pos, CAST(id AS BIGINT) AS id, CAST(seen_at AS BIGINT) AS ts, CAST(event_id AS BIGINT) AS event_id
FROM (SELECT event_type || '/' || CAST(CAST(ts AS DATE) AS STRING) AS route_key, event_id,
             row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn,
             CASE WHEN event_id % 4 = 0 OR event_id % 60 < 25 THEN NULL ELSE user_id % 7 END AS id,
             CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id * 37 % 1001 END AS seen_at
      FROM {events}) numbered""",
    # runs of a customer's priorities by year, each floored by the year before if that one advanced
    "state": """
SELECT route_key, bundle_id, pos, high_water_time, low_water_time, contiguous, contiguous AS advanced,
       CASE WHEN before_ok THEN CASE WHEN cust % 13 = 0 THEN 'elsewhere' ELSE before_id END ELSE NULL END AS floor_from_bundle_id,
       CASE WHEN before_ok THEN CASE WHEN cust % 11 = 0 THEN before_high || '!' ELSE before_high END ELSE NULL END AS floor_time
FROM (SELECT *, lag(contiguous) OVER (PARTITION BY route_key ORDER BY bundle_id) AS before_ok,
             lag(bundle_id) OVER (PARTITION BY route_key ORDER BY bundle_id) AS before_id,
             lag(high_water_time) OVER (PARTITION BY route_key ORDER BY bundle_id) AS before_high
      FROM (SELECT CAST(o_custkey AS STRING) || '/' || o_orderpriority AS route_key, CAST(year(o_orderdate) AS STRING) AS bundle_id, max(o_custkey) AS cust,
                   CAST(2100 - max(year(o_orderdate)) AS BIGINT) AS pos, max(CAST(CAST(o_orderdate AS DATE) AS STRING)) AS high_water_time,
                   min(CAST(CAST(o_orderdate AS DATE) AS STRING)) AS low_water_time, sum(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) = 0 AS contiguous
            FROM {orders} GROUP BY CAST(o_custkey AS STRING) || '/' || o_orderpriority, CAST(year(o_orderdate) AS STRING)) runs) lagged""",
    # conversations as chains of bundles, with forks (turn 3 follows turn 1) and cycles (turn 0 of every tenth follows turn 1)
    "bundles": """
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS bundle_id, CAST(turn AS BIGINT) AS time_key,
       CAST(CASE WHEN turn = 3 THEN conv_id * 1000 + 1 WHEN turn > 0 THEN conv_id * 1000 + turn - 1 WHEN conv_id % 10 = 0 THEN conv_id * 1000 + 1 ELSE NULL END AS BIGINT) AS previous_bundle_id
FROM (SELECT DISTINCT conv_id, turn FROM {conversations}) turns""",
    # responses that reach every rule
    "responses": """
SELECT CAST(page_id AS BIGINT) AS page_id,
       CASE WHEN page_id % 31 = 1 THEN 'not a url' WHEN page_id % 31 = 2 THEN 'https://sec.example.com/c' WHEN page_id % 31 = 3 THEN 'https://a.sec.example.com/c' ELSE url END AS final_url,
       CAST(CASE page_id % 29 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 418 WHEN 5 THEN 503 WHEN 6 THEN 302 ELSE 200 END AS INTEGER) AS status,
       CASE page_id % 23 WHEN 1 THEN '' WHEN 2 THEN '<title> Sign in </title>' || html WHEN 3 THEN html || 'unusual requests' WHEN 4 THEN html || 'too many requests, CAPTCHA'
            WHEN 5 THEN html || 'Page not found' WHEN 6 THEN 'plain text' WHEN 7 THEN '<html no title' ELSE html END AS body
FROM {pages}""",
    # segments as declared, some wrongly
    "segments": """
SELECT segment AS filename, CAST(CASE WHEN segment = 'data-3' THEN n + 1 ELSE n END AS BIGINT) AS record_count
FROM (SELECT 'data-' || CAST(o_orderkey % 7 AS STRING) AS segment, count(*) AS n FROM {orders} WHERE o_orderkey % 7 <> 5 GROUP BY 'data-' || CAST(o_orderkey % 7 AS STRING)) s
UNION ALL SELECT 'data-9' AS filename, CAST(4 AS BIGINT) AS record_count""",
    # files of two copies of bundles
    "files": """
SELECT 'b' || CAST(l_orderkey % 97 AS STRING) AS bundle_id, CASE WHEN l_linenumber = 7 THEN 'manifest.json' ELSE 'f' || CAST(l_linenumber AS STRING) END AS name,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes
FROM {lineitem} GROUP BY 'b' || CAST(l_orderkey % 97 AS STRING), CASE WHEN l_linenumber = 7 THEN 'manifest.json' ELSE 'f' || CAST(l_linenumber AS STRING) END""",
    # a queue's items
    "frontier": """
SELECT CAST(event_id AS BIGINT) AS seq, 'k' || CAST(user_id * 31 % 400 AS STRING) AS url_key, 'r' || CAST(user_id % 40 AS STRING) AS route_key,
       CASE WHEN event_id % 97 = 0 THEN 'in_flight' WHEN event_id % 89 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'done' ELSE 'pending' END AS state,
       user_id % 2 = 0 AS ordered, CAST(user_id % 5 AS INTEGER) AS priority, event_id % 6 <> 0 AS gate_open
FROM {events}""",
    # pages, gaps and ends of runs, as a stream brings them
    "run_rows": """
SELECT CAST(user_id % 20 AS STRING) AS route_key, CASE WHEN event_id % 50 = 49 THEN 'end' WHEN event_id % 400 = 7 THEN 'gap' ELSE 'page' END AS kind,
       CAST(floor(event_id / 10.0) AS BIGINT) AS page, CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 37 END AS BIGINT) AS id,
       CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id * 7 % 5003 END AS BIGINT) AS ts, CASE WHEN event_id % 110 = 0 THEN 'soon' ELSE NULL END AS raw, CAST(event_id AS BIGINT) AS event_id
FROM {events}""",
    # times as sites write them
    "raw_times": """
SELECT CAST(event_id AS BIGINT) AS event_id,
       CASE event_id % 6 WHEN 0 THEN '2024-' || CAST(event_id % 14 AS STRING) || '-' || CAST(event_id % 33 AS STRING)
            WHEN 1 THEN '2024-0' || CAST(event_id % 9 + 1 AS STRING) || '-1' || CAST(event_id % 10 AS STRING) || ' 0' || CAST(event_id % 10 AS STRING) || ':3' || CAST(event_id % 10 AS STRING)
            WHEN 2 THEN '2023-02-' || CAST(event_id % 7 + 25 AS STRING) || 'T23:5' || CAST(event_id % 10 AS STRING) || ':0' || CAST(event_id % 10 AS STRING)
            WHEN 3 THEN 'yesterday' WHEN 4 THEN '2024-11-05 21:04:5' || CAST(event_id % 10 AS STRING) ELSE NULL END AS raw
FROM {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = ADAPTERS[name]
    used = [t for t in TABLES if f"{{{t}}}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def oracle_view(name: str) -> str:
    """The adapter as a subquery of DuckDB SQL."""
    text = ADAPTERS[name]
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return f"({text}) {name}"

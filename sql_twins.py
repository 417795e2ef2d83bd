"""DuckDB SQL for the queries of ``revpulse.registry``: the same result, written independently."""

from __future__ import annotations

_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}
SQL: dict[str, str] = {}


def cte(name: str, body: str, *needs: str) -> None:
    _CTES[name] = (body, needs)


def query(name: str, body: str, *needs: str) -> None:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for m in _CTES[n][1]:
            visit(m)
        order.append(n)

    for n in needs:
        visit(n)
    head = "WITH " + ",\n".join(f"{n} AS ({_CTES[n][0]})" for n in order) + "\n" if order else ""
    SQL[name] = head + body


def money(c: str) -> str:
    return f"CAST({c} AS DOUBLE) / 100"


def mean(c: str, n: str) -> str:
    """Mean of n amounts that sum to c cents, rounded half up to whole cents."""
    return f"CAST((2 * ({c}) + ({n})) // (2 * ({n})) AS DOUBLE) / 100"


def five(ts: str, size: str = "5 minutes") -> str:
    return f"time_bucket(INTERVAL '{size}', {ts}, TIMESTAMP '1970-01-01 00:00:00')"


AS_OF = "(SELECT max(ts) FROM events)"
BASE = ("CASE category WHEN 'Electronics' THEN 2800.0::DOUBLE WHEN 'Footwear' THEN 400 WHEN 'Apparel' THEN 250 "
        "WHEN 'Home' THEN 600 WHEN 'Accessories' THEN 120 ELSE 300 END")
WEIGHT = ("CASE region WHEN 'Delhi' THEN 0.30::DOUBLE WHEN 'Maharashtra' THEN 0.25 WHEN 'Karnataka' THEN 0.15 "
          "WHEN 'Tamil Nadu' THEN 0.20 WHEN 'West Bengal' THEN 0.10 ELSE 0.15 END")
CAT_ENC = ("CASE category WHEN 'Electronics' THEN 0 WHEN 'Footwear' THEN 1 WHEN 'Apparel' THEN 2 WHEN 'Home' THEN 3 "
           "WHEN 'Accessories' THEN 4 ELSE -1 END")
REG_ENC = ("CASE region WHEN 'Delhi' THEN 0 WHEN 'Maharashtra' THEN 1 WHEN 'Karnataka' THEN 2 WHEN 'Tamil Nadu' THEN 3 "
           "WHEN 'West Bengal' THEN 4 ELSE -1 END")
HOUR_F = ("CASE WHEN hour < 6 THEN 0.3::DOUBLE WHEN hour < 9 THEN 0.7 WHEN hour < 12 THEN 1.2 WHEN hour < 14 THEN 1.4 "
          "WHEN hour < 18 THEN 1.1 WHEN hour < 21 THEN 1.3 ELSE 0.6 END")
DOW_F = ("CASE day_of_week WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.85 WHEN 2 THEN 0.9 WHEN 3 THEN 1.0 WHEN 4 THEN 1.15 "
         "WHEN 5 THEN 1.3 ELSE 1.2 END")
SEVERITY = ("CASE WHEN revenue_ratio < 0.2 OR revenue_ratio > 4 THEN 'critical' "
            "WHEN revenue_ratio < 0.4 OR revenue_ratio > 2.5 THEN 'high' ELSE 'medium' END")
RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 3 END"
RUPEES = "format('₹{{:,.2f}}', {}::DOUBLE)".format
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')".format

# --- tables ---------------------------------------------------------------------------

cte("order_events", """
SELECT CAST(event_id AS VARCHAR) AS event_id, 'order_placed' AS event_type, ts AS event_timestamp,
  concat('ORD-', lpad(CAST(event_id AS VARCHAR), 8, '0')) AS order_id,
  concat('SKU-', CAST(1001 + event_id % 30 AS VARCHAR)) AS product_id,
  concat('Product ', CAST(1001 + event_id % 30 AS VARCHAR)) AS product_name,
  CASE event_type WHEN 'click' THEN 'Electronics' WHEN 'view' THEN 'Footwear' WHEN 'signup' THEN 'Apparel'
    WHEN 'purchase' THEN 'Home' ELSE 'Accessories' END AS category,
  CAST(1 + event_id % 5 AS INTEGER) AS quantity, CAST(value AS DECIMAL(10,2)) AS unit_price,
  CAST(CAST(value AS DECIMAL(10,2)) * CAST(1 + event_id % 5 AS INTEGER) AS DECIMAL(10,2)) AS total_amount,
  CASE user_id % 5 WHEN 0 THEN 'Delhi' WHEN 1 THEN 'Maharashtra' WHEN 2 THEN 'Karnataka' WHEN 3 THEN 'Tamil Nadu'
    ELSE 'West Bengal' END AS region,
  CASE event_id % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'debit_card' WHEN 2 THEN 'digital_wallet'
    ELSE 'buy_now_pay_later' END AS payment_method,
  ts + to_seconds(event_id % 7) AS ingested_at
FROM events""")

cte("order_lines", """
SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS event_id,
  l_shipdate AS event_timestamp, p_type AS category, r_name AS region, CAST(l_quantity AS INTEGER) AS quantity,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS total_amount, o_orderpriority AS payment_method
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey""")

# Message parts: kind 0 cut off, 1 no id, 2 no time, 3 wrong total, -1 fine.
cte("wire", """
SELECT *, CASE kind WHEN 0 THEN substr(message, 1, 60) ELSE message END AS value FROM (
  SELECT *, '{' || CASE WHEN kind = 1 THEN '' ELSE '"event_id":"' || event_id || '",' END
    || '"event_type":"order_placed","timestamp":"'
    || CASE WHEN kind = 2 THEN 'not a time' ELSE strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') END
    || '","order_id":"' || order_id || '","product_id":"' || product_id || '","product_name":"' || product_name
    || '","category":"' || category || '","quantity":' || quantity || ',"unit_price":' || CAST(CAST(unit_price AS DOUBLE) AS VARCHAR)
    || ',"total_amount":' || CAST(CAST(sent_total AS DOUBLE) AS VARCHAR) || ',"region":"' || region
    || '","payment_method":"' || payment_method || '"}' AS message
  FROM (
    SELECT *, CASE WHEN kind = 3 THEN total_amount + 1 ELSE total_amount END AS sent_total FROM (
      SELECT *, CAST(event_id AS BIGINT) AS n,
        CASE WHEN category = 'Accessories' THEN CAST(event_id AS BIGINT) % 4 ELSE -1 END AS kind FROM order_events)))""", "order_events")

ALL_MISSING = ("malformed,missing_event_id,missing_event_type,missing_event_timestamp,missing_order_id,missing_product_id,"
               "missing_product_name,missing_category,missing_quantity,missing_unit_price,missing_total_amount,"
               "missing_region,missing_payment_method")
ERROR_OF = (f"CASE kind WHEN 0 THEN '{ALL_MISSING}' WHEN 1 THEN 'missing_event_id' WHEN 2 THEN 'missing_event_timestamp' "
            "WHEN 3 THEN 'amount_mismatch' ELSE '' END")

cte("m", f"""
SELECT *, window_start + INTERVAL '5 minutes' AS window_end, {money('cents')} AS total_revenue,
  {mean('cents', 'order_count')} AS avg_order_value
FROM (SELECT {five('event_timestamp')} AS window_start, category, region, count(*) AS order_count,
        CAST(sum(total_amount) * 100 AS BIGINT) AS cents
      FROM order_events GROUP BY ALL)""", "order_events")

cte("f", f"""
SELECT computed_at, category, region,
  {money('c5')} AS revenue_last_5m, CAST(n5 AS BIGINT) AS orders_last_5m,
  {money('c15')} AS revenue_last_15m, CAST(n15 AS BIGINT) AS orders_last_15m,
  CASE WHEN n15 > 0 THEN {mean('c15', 'n15')} ELSE 0 END AS avg_order_value_last_15m,
  {money('c60')} AS revenue_last_60m, CAST(n60 AS BIGINT) AS orders_last_60m,
  CASE WHEN c15 > 0 THEN round(CAST(c5 AS DOUBLE) * 3 / c15, 4) ELSE 0 END AS revenue_trend_pct
FROM (
  SELECT {five('event_timestamp')} + to_minutes(CAST(5 + 5 * s AS BIGINT)) AS computed_at, category, region,
    CAST(sum(CASE WHEN s < 1 THEN total_amount * 100 ELSE 0 END) AS BIGINT) AS c5, count(*) FILTER (s < 1) AS n5,
    CAST(sum(CASE WHEN s < 3 THEN total_amount * 100 ELSE 0 END) AS BIGINT) AS c15, count(*) FILTER (s < 3) AS n15,
    CAST(sum(total_amount * 100) AS BIGINT) AS c60, count(*) AS n60
  FROM order_events, range(0, 12) AS steps(s) GROUP BY ALL)""", "order_events")

cte("e", f"""
SELECT *, CASE WHEN expected_revenue > 0 THEN round_even(total_revenue / expected_revenue * 10000, 0) / 10000 ELSE 0 END AS revenue_ratio
FROM (SELECT *, round_even(base_revenue * region_weight * hour_factor * dow_factor * 100, 0) / 100 AS expected_revenue
  FROM (SELECT *, {BASE} AS base_revenue, {WEIGHT} AS region_weight, {HOUR_F} AS hour_factor, {DOW_F} AS dow_factor,
      {CAT_ENC} AS category_enc, {REG_ENC} AS region_enc
    FROM (SELECT *, CAST(hour(window_start) AS INTEGER) AS hour, CAST(isodow(window_start) - 1 AS INTEGER) AS day_of_week FROM m)))""", "m")

cte("a", f"""
SELECT strftime(window_start, '%Y%m%d%H%M') || '|' || category || '|' || region AS anomaly_id, window_end AS detected_at,
  window_start, window_end, category, region, total_revenue AS actual_revenue, expected_revenue,
  CASE severity WHEN 'critical' THEN 0.95::DOUBLE ELSE 0.75 END AS anomaly_score, severity,
  CASE WHEN severity = 'critical' AND hour % 3 = 0 THEN 'acknowledged' WHEN severity = 'high' AND hour % 3 = 1 THEN 'false_positive'
    ELSE 'open' END AS status
FROM (SELECT *, {SEVERITY} AS severity FROM e) WHERE severity <> 'medium'""", "e")

cte("r", """
SELECT anomaly_id, detected_at + INTERVAL '90 seconds' AS created_at, severity, category, region, actual_revenue, expected_revenue,
  CASE region WHEN 'Delhi' THEN 0.35::DOUBLE WHEN 'Karnataka' THEN 0.6 ELSE 0.85 END AS confidence,
  round(greatest(expected_revenue - actual_revenue, 0), 2) AS estimated_loss
FROM a WHERE status = 'acknowledged'""", "a")

cte("texts", r"""
SELECT anomaly_id, CASE category
  WHEN 'Electronics' THEN E'ANOMALY_REPORT_START\nEstimated Loss: ₹ ' || format('{:,.2f}', abs(expected_revenue - actual_revenue))
    || E'\nConfidence: 85\nRoot Cause: ' || cause || E'\nRecommended Action: Check stock of ' || place || E'.\nANOMALY_REPORT_END\nDone.'
  WHEN 'Footwear' THEN E'Confidence: 0.90\nRoot Cause: ' || cause || E'\nRecommended Action: Inspect  further.'
  WHEN 'Apparel' THEN E'Root Cause Analysis:\n' || cause || E' It should be checked soon.\nRecommended Action: Count stock.'
  WHEN 'Home' THEN 'Estimated Loss: ' || format('{:,.2f}', expected_revenue * 1000 + 5000)
    || E'\nConfidence = 0.99\nRoot cause: A drop.\nRecommended Action: Wait.'
  ELSE E'Short.\n\n  ' || cause || E'  \n\nEnd.' END AS report_text
FROM (SELECT *, category || ' in ' || region AS place,
  'Revenue of ' || category || ' in ' || region || ' was ' || format('₹{:,.2f}', actual_revenue) || E' against\n'
    || format('₹{:,.2f}', expected_revenue) || ' expected.' AS cause
  FROM a WHERE status = 'acknowledged')""", "a")

cte("dlq", f"""
SELECT lpad(CAST(n AS VARCHAR), 12, '0') AS dlq_id, n, kind,
  CASE WHEN n % 3 = 0 THEN replace(value, 'not a time', '2024-01-31T00:00:00Z') ELSE value END AS event_data,
  CAST(n % 7 AS INTEGER) AS retry_count, event_timestamp AS first_failed, n % 5 = 0 AS resolved,
  CASE WHEN kind = 2 AND n % 3 = 0 THEN '' ELSE {ERROR_OF} END AS problem
FROM wire WHERE kind >= 0""", "wire")

cte("cfg", """
SELECT 'simulate_' || event_type AS key, CASE WHEN count(*) % 3 = 0 THEN 'true' ELSE 'false' END AS value,
  date_trunc('day', ts)::TIMESTAMP AS updated_at FROM events GROUP BY event_type, date_trunc('day', ts)""")

cte("samples", "SELECT 'orders_total' AS name, event_type AS label, ts, CAST(event_id % 500 AS DOUBLE) AS value FROM events")

cte("deltas", """
SELECT name, label, ts, CASE WHEN value < prev THEN value ELSE value - prev END AS delta
FROM (SELECT *, lag(value) OVER (PARTITION BY label ORDER BY ts, value) AS prev FROM samples) WHERE prev IS NOT NULL""", "samples")

cte("batches", """
SELECT event_type AS sink, date_diff('hour', TIMESTAMP '2024-01-01', h) AS batch_id, h + INTERVAL '1 hour' AS finished_at,
  n AS input_rows, n % 3 = 0 AS failed
FROM (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL)""")

cte("models", """
SELECT day || '_000000' AS version, trained_at, round(CAST(num_anomalies AS DOUBLE) / num_samples, 4) AS f1, num_samples, num_anomalies,
  day AS data_hash, CASE WHEN substr(day, 7, 2) = '05' THEN 'production' ELSE 'candidate' END AS status
FROM (SELECT strftime(window_start, '%Y%m%d') AS day, min(window_start) AS trained_at, count(*) AS num_samples,
        count(*) FILTER (revenue_ratio < 0.2 OR revenue_ratio > 4) AS num_anomalies FROM e GROUP BY 1)""", "e")

cte("labelled", """
SELECT m.window_start, m.window_end, m.category, m.region, m.order_count, m.total_revenue, m.avg_order_value,
  CASE WHEN a.anomaly_id IS NOT NULL THEN 1 ELSE 0 END AS is_anomaly
FROM m LEFT JOIN a ON m.window_start = a.window_start AND m.category = a.category AND m.region = a.region AND a.status <> 'false_positive'""", "m", "a")

cte("scored", """
SELECT m.window_start, m.category, m.region, m.total_revenue, m.order_count, m.avg_order_value,
  coalesce(a.anomaly_score, 0) AS anomaly_score, a.severity
FROM m LEFT JOIN a ON m.window_start = a.window_start AND m.category = a.category AND m.region = a.region""", "m", "a")

METRIC = "window_start, window_end, category, region, order_count, total_revenue, avg_order_value"
ANOMALY = "anomaly_id, detected_at, window_start, window_end, category, region, actual_revenue, expected_revenue, anomaly_score, severity, status"
WIRE_COLS = "event_type, order_id, product_id, product_name, category, quantity, CAST(unit_price AS DOUBLE) AS unit_price"

# --- ingest ------------------------------------------------------------------------------

query("parse_order_events", """
SELECT CASE WHEN kind IN (0, 1) THEN NULL ELSE event_id END AS event_id, CASE WHEN kind <> 0 THEN event_type END AS event_type,
  CASE WHEN kind NOT IN (0, 2) THEN event_timestamp END AS event_timestamp, CASE WHEN kind <> 0 THEN order_id END AS order_id,
  CASE WHEN kind <> 0 THEN product_id END AS product_id, CASE WHEN kind <> 0 THEN product_name END AS product_name,
  CASE WHEN kind <> 0 THEN category END AS category, CASE WHEN kind <> 0 THEN quantity END AS quantity,
  CASE WHEN kind <> 0 THEN CAST(unit_price AS DOUBLE) END AS unit_price, CASE WHEN kind <> 0 THEN CAST(sent_total AS DOUBLE) END AS total_amount,
  CASE WHEN kind <> 0 THEN region END AS region, CASE WHEN kind <> 0 THEN payment_method END AS payment_method, kind = 0 AS corrupt
FROM wire""", "wire")
query("validate_events", f"SELECT {ERROR_OF} AS failed_checks, count(*) AS messages FROM wire GROUP BY 1", "wire")
query("route_good_events", f"""
SELECT event_id, event_timestamp, {WIRE_COLS}, CAST(total_amount AS DOUBLE) AS total_amount, region, payment_method
FROM wire WHERE kind < 0""", "wire")
query("route_dead_letters", f"""
SELECT substr(sha256(value), 1, 32) AS dlq_id, value AS event_data, {ERROR_OF} AS error, 0 AS retry_count, false AS resolved
FROM wire WHERE kind >= 0""", "wire")
query("dedup_events", """
SELECT event_id, event_timestamp, category, region, quantity, CAST(total_amount AS DOUBLE) AS total_amount, payment_method
FROM (SELECT *, row_number() OVER (PARTITION BY event_id
        ORDER BY event_timestamp DESC, category, region, quantity, total_amount, payment_method) AS k FROM order_lines) WHERE k = 1""", "order_lines")
query("partition_by_region", "SELECT region, event_timestamp, event_id, CAST(total_amount AS DOUBLE) AS total_amount FROM order_events", "order_events")
query("shard_of", """
SELECT CASE region WHEN 'Delhi' THEN 'postgres-east' WHEN 'Karnataka' THEN 'postgres-south' WHEN 'Maharashtra' THEN 'postgres-west'
  WHEN 'West Bengal' THEN 'postgres-east2' ELSE 'postgres' END AS shard, count(*) AS events FROM order_events GROUP BY 1""", "order_events")

# --- windows -----------------------------------------------------------------------------

query("revenue_metrics", f"SELECT {METRIC} FROM m", "m")
query("revenue_metrics_daily_lines", f"""
SELECT window_start, window_start + INTERVAL '1 day' AS window_end, category, region, order_count,
  {money('c')} AS total_revenue, {mean('c', 'order_count')} AS avg_order_value
FROM (SELECT date_trunc('day', event_timestamp)::TIMESTAMP AS window_start, category, region, count(*) AS order_count,
  CAST(sum(total_amount) * 100 AS BIGINT) AS c FROM order_lines GROUP BY ALL)""", "order_lines")
for size, steps in (("5m", 1), ("15m", 3), ("60m", 12)):
    avg = f", {mean('c', 'orders')} AS avg_order_value" if size == "15m" else ""
    query(f"features_{size}", f"""
SELECT computed_at, category, region, {money('c')} AS revenue, orders{avg}
FROM (SELECT {five('event_timestamp')} + to_minutes(CAST(5 + 5 * s AS BIGINT)) AS computed_at, category, region,
        CAST(sum(total_amount * 100) AS BIGINT) AS c, count(*) AS orders
      FROM order_events, range(0, {steps}) AS steps(s) GROUP BY ALL)""", "order_events")
query("feature_store", "SELECT * FROM f", "f")
query("merge_features", "SELECT * FROM f", "f")

# --- keyed tables --------------------------------------------------------------------------

query("upsert", f"""
SELECT coalesce(n.window_start, o.window_start) AS window_start, coalesce(n.window_end, o.window_end) AS window_end,
  coalesce(n.category, o.category) AS category, coalesce(n.region, o.region) AS region,
  coalesce(n.order_count + 1, o.order_count) AS order_count, coalesce(n.total_revenue, o.total_revenue) AS total_revenue,
  coalesce(n.avg_order_value, o.avg_order_value) AS avg_order_value
FROM (SELECT * FROM m WHERE window_start < {AS_OF} - INTERVAL '10 days') o
FULL JOIN (SELECT * FROM m WHERE window_start >= {AS_OF} - INTERVAL '17 days') n
  ON o.window_start = n.window_start AND o.category = n.category AND o.region = n.region""", "m")
query("upsert_partial", f"""
SELECT computed_at, category, region, CASE WHEN new THEN revenue_last_5m * 2 ELSE revenue_last_5m END AS revenue_last_5m, orders_last_5m,
  CASE WHEN old THEN revenue_last_15m ELSE 0 END AS revenue_last_15m, CASE WHEN old THEN orders_last_15m ELSE 0 END AS orders_last_15m,
  CASE WHEN old THEN avg_order_value_last_15m ELSE 0 END AS avg_order_value_last_15m, CASE WHEN old THEN revenue_last_60m ELSE 0 END AS revenue_last_60m,
  CASE WHEN old THEN orders_last_60m ELSE 0 END AS orders_last_60m, CASE WHEN old THEN revenue_trend_pct ELSE 0 END AS revenue_trend_pct
FROM (SELECT f.*, computed_at < t - INTERVAL '10 days' AS old, computed_at >= t - INTERVAL '17 days' AS new FROM f, (SELECT max(ts) AS t FROM events))
WHERE old OR new""", "f")
query("insert_if_absent", f"""
SELECT {ANOMALY} FROM a WHERE window_start >= {AS_OF} - INTERVAL '17 days' AND NOT window_start < {AS_OF} - INTERVAL '10 days'""", "a")
query("append_rows", f"""
SELECT * FROM r WHERE created_at < {AS_OF} - INTERVAL '10 days' UNION ALL
SELECT * FROM r WHERE created_at >= {AS_OF} - INTERVAL '17 days'""", "r")
query("read_warehouse", """
SELECT l_returnflag, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue
FROM lineitem GROUP BY 1""")
query("training_csv", """
SELECT l.window_start, l.window_end, l.category, l.region, e.hour, e.day_of_week, l.order_count, l.total_revenue, l.avg_order_value,
  e.expected_revenue, e.revenue_ratio, l.is_anomaly
FROM labelled l JOIN e ON l.window_start = e.window_start AND l.category = e.category AND l.region = e.region""", "labelled", "e")
query("write_monthly", """
SELECT event_id, event_timestamp, category, region, quantity, CAST(total_amount AS DOUBLE) AS total_amount, payment_method,
  strftime(event_timestamp, '%Y_%m') AS event_month FROM order_lines""", "order_lines")
query("prune_months", """
SELECT strftime(event_timestamp, '%Y_%m') AS event_month, count(*) AS rows FROM order_lines
WHERE event_timestamp >= TIMESTAMP '1997-03-15' AND event_timestamp < TIMESTAMP '1998-02-10' GROUP BY 1""", "order_lines")
query("read_since", f"""
SELECT {ANOMALY} FROM a WHERE (detected_at, anomaly_id) > (TIMESTAMP '2024-01-15 12:00:00', '') ORDER BY detected_at, anomaly_id LIMIT 50""", "a")

# --- baseline and detection -------------------------------------------------------------------

query("engineer_features", "SELECT * EXCLUDE (cents) FROM e", "e")
UNSCORED = f"""
SELECT {METRIC} FROM m WHERE window_end <= {AS_OF} AND NOT EXISTS (SELECT 1 FROM a WHERE a.window_start = m.window_start
  AND a.category = m.category AND a.region = m.region)"""
query("unscored_windows", UNSCORED, "m", "a")
query("unscored_windows_newest", UNSCORED + " ORDER BY window_start DESC, category, region LIMIT 500", "m", "a")
query("rule_anomalies", f"SELECT {ANOMALY} FROM a", "a")
query("detection_job", f"""
SELECT * REPLACE ('open' AS status) FROM (SELECT {ANOMALY} FROM a WHERE status <> 'acknowledged' AND window_end <= {AS_OF})""", "a")
query("critical_alerts", r"""
SELECT anomaly_id, detected_at, E'🚨 *CRITICAL ANOMALY DETECTED*\nCategory: ' || category || ' | Region: ' || region
  || E'\nActual: ' || format('₹{:.2f}', actual_revenue) || ' vs Expected: ' || format('₹{:.2f}', expected_revenue)
  || E'\nScore: ' || format('{:.3f}', anomaly_score) || E'\n' AS text FROM a WHERE severity = 'critical'""", "a")
query("severity_rank", f"SELECT {RANK} AS severity_rank, severity, count(*) AS anomalies FROM a GROUP BY ALL", "a")
query("status_domain", """
SELECT status, count(*) FILTER (status IN ('open', 'acknowledged', 'false_positive', 'confirmed')) AS valid, count(*) AS rows
FROM a GROUP BY 1""", "a")

# --- training -------------------------------------------------------------------------------

query("label_windows", "SELECT * FROM labelled", "labelled")
query("data_fingerprint", f"""
SELECT substr(sha256(coalesce(sum(('0x' || substr(sha256(concat_ws('|', format('{{:.6f}}', avg_order_value::DOUBLE), category, is_anomaly,
  order_count, region, format('{{:.6f}}', total_revenue::DOUBLE), {STAMP('window_end')}, {STAMP('window_start')})), 1, 15))::BIGINT), 0)
  || ':' || count(*)), 1, 16) AS data_hash FROM labelled""", "labelled")
query("class_balance", """
SELECT count(*) FILTER (is_anomaly = 0) AS normal_rows, count(*) FILTER (is_anomaly = 1) AS anomaly_rows,
  CAST(count(*) FILTER (is_anomaly = 0) AS DOUBLE) / count(*) FILTER (is_anomaly = 1) AS positive_weight FROM labelled""", "labelled")
query("classification_report", f"""
SELECT CAST(c AS INTEGER) AS class, prec AS precision, rec AS recall, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1, support
FROM (SELECT c, coalesce(CAST(count(*) FILTER (label = c AND guess = c) AS DOUBLE) / nullif(count(*) FILTER (guess = c), 0), 0) AS prec,
    coalesce(CAST(count(*) FILTER (label = c AND guess = c) AS DOUBLE) / nullif(count(*) FILTER (label = c), 0), 0) AS rec,
    count(*) FILTER (label = c) AS support
  FROM (SELECT l.is_anomaly AS label, CASE WHEN {SEVERITY} = 'critical' THEN 1 ELSE 0 END AS guess
        FROM labelled l JOIN e ON l.window_start = e.window_start AND l.category = e.category AND l.region = e.region), range(0, 2) AS classes(c)
  GROUP BY c)""", "labelled", "e")
query("promotion_gate", """
SELECT version, trained_at, f1, num_samples, num_anomalies, data_hash,
  CASE WHEN version = (SELECT max(version) FROM models) THEN CASE WHEN ok THEN 'production' ELSE 'candidate' END
    WHEN status = 'production' AND ok THEN 'archived' ELSE status END AS status
FROM models, (SELECT n.num_samples >= 100 AND n.num_anomalies > 0 AND n.num_anomalies < n.num_samples
    AND n.f1 >= coalesce((SELECT max(f1) FROM models WHERE status = 'production' AND version <> n.version), 0) AS ok
  FROM models n WHERE version = (SELECT max(version) FROM models))""", "models")
query("rollback", """
SELECT version, trained_at, f1, num_samples, num_anomalies, data_hash,
  CASE WHEN NOT EXISTS (SELECT 1 FROM models WHERE version = '20240112_000000') THEN status
    WHEN version = '20240112_000000' THEN 'production' WHEN status = 'production' THEN 'archived' ELSE status END AS status FROM models""", "models")
query("model_versions", "SELECT version, f1, data_hash, status FROM models", "models")

# --- drift ------------------------------------------------------------------------------------

query("scored_windows", "SELECT * FROM scored", "scored")
query("score_stats", """
SELECT count(*) AS windows, round(avg(CASE WHEN anomaly_score > 0.5 THEN 1.0::DOUBLE ELSE 0 END), 8) AS anomaly_rate,
  round(avg(anomaly_score), 8) AS avg_score, round(stddev_samp(anomaly_score), 8) AS score_std FROM scored""", "scored")
TENTHS = "[0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]"
query("percentile_edges", f"""
SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS position, round(x, 6) AS edge
FROM (SELECT DISTINCT unnest(quantile_cont(total_revenue, {TENTHS})) AS x FROM m)""", "m")
cte("slices", f"""
SELECT *, CASE WHEN window_start >= {AS_OF} - INTERVAL '10 days' THEN 'actual' ELSE 'expected' END AS slice
FROM m WHERE window_start >= {AS_OF} - INTERVAL '31 days'""", "m")
query("histogram", f"""
SELECT * FROM (WITH e AS (SELECT category, list_sort(list_distinct(quantile_cont(total_revenue, {TENTHS}))) AS edges FROM slices GROUP BY 1),
b AS (SELECT category, CAST(unnest(range(0, greatest(len(edges) - 1, 1))) AS INTEGER) AS bin FROM e),
c AS (SELECT category, bin, count(*) FILTER (slice = 'expected') AS x, count(*) FILTER (slice = 'actual') AS y
  FROM (SELECT category, slice, greatest(CAST(least(len(list_filter(edges, lambda x: x <= total_revenue)), len(edges) - 1) - 1 AS INTEGER), 0) AS bin
    FROM slices JOIN e USING (category)) GROUP BY ALL)
SELECT category, bin, coalesce(x, 0) AS expected_rows, coalesce(y, 0) AS actual_rows FROM b LEFT JOIN c USING (category, bin))""", "slices")


def psi_sql(rows: str, by: str) -> str:
    """Index per ``by`` from rows (by, v, slice)."""
    return f"""
SELECT {by}, round(sum((act - ex) * ln(act / ex)), 6) AS psi FROM (
  SELECT {by}, greatest(n_e / sum(n_e) OVER (PARTITION BY {by}), 1e-6) AS ex, greatest(n_a / sum(n_a) OVER (PARTITION BY {by}), 1e-6) AS act
  FROM (SELECT {by}, bin, CAST(count(*) FILTER (slice = 'expected') AS DOUBLE) AS n_e, CAST(count(*) FILTER (slice = 'actual') AS DOUBLE) AS n_a
    FROM (SELECT {by}, slice, least(len(list_filter(edges, lambda x: x <= v)), len(edges) - 1) AS bin
      FROM ({rows}) JOIN (SELECT {by}, list_sort(list_distinct(quantile_cont(v, {TENTHS}))) AS edges FROM ({rows}) GROUP BY 1) USING ({by}))
    GROUP BY ALL)) GROUP BY 1"""


ONE = "SELECT 'total_revenue' AS measure, total_revenue AS v, slice FROM slices"
query("psi", f"SELECT psi FROM ({psi_sql(ONE, 'measure')})", "slices")
query("psi_by_measure", psi_sql(
    ONE + " UNION ALL SELECT 'order_count', CAST(order_count AS DOUBLE), slice FROM slices"
    " UNION ALL SELECT 'avg_order_value', avg_order_value, slice FROM slices", "measure"), "slices")
def drift_sql(hours: int) -> str:
    cte(f"drift_slices_{hours}", f"""
SELECT *, CASE WHEN window_start >= {AS_OF} - INTERVAL '{hours} hours' THEN 'actual' ELSE 'expected' END AS slice
FROM m WHERE window_start >= {AS_OF} - INTERVAL '7 days'""", "m")
    cte(f"drift_psi_{hours}", psi_sql(
        f"SELECT 'total_revenue' AS measure, total_revenue AS v, slice FROM drift_slices_{hours}"
        f" UNION ALL SELECT 'order_count', CAST(order_count AS DOUBLE), slice FROM drift_slices_{hours}", "measure"), f"drift_slices_{hours}")
    enough = f"(SELECT count(*) FROM drift_slices_{hours} WHERE slice = 'expected') >= 50"
    cte(f"drift_{hours}", f"""
SELECT measured_at, window_hours, round(rate, 8) AS anomaly_rate, round(mean_score, 8) AS avg_score, round(std, 8) AS score_std,
  psi_revenue, psi_order_count, notes <> '' AS drift_flag, CASE WHEN n < 50 THEN 'not enough windows' ELSE nullif(notes, '') END AS notes
FROM (SELECT *, concat_ws('; ',
    CASE WHEN psi_revenue > 0.2 THEN format('Revenue distribution shift: PSI={{:.3f}}', psi_revenue) END,
    CASE WHEN psi_order_count > 0.2 THEN format('Order count distribution shift: PSI={{:.3f}}', psi_order_count) END,
    CASE WHEN abs(rate - 0.05) > 0.15 THEN format('Anomaly rate {{:.1f}}% far from expected 5.0%', rate * 100) END,
    CASE WHEN std < 0.01 THEN format('Score distribution collapsed: std={{:.4f}}', std) END) AS notes
  FROM (SELECT measured_at, window_hours, n, CASE WHEN n >= 50 THEN rate END AS rate, CASE WHEN n >= 50 THEN mean_score END AS mean_score,
    CASE WHEN n >= 50 THEN std END AS std, CASE WHEN n >= 50 THEN psi_revenue END AS psi_revenue, CASE WHEN n >= 50 THEN psi_order_count END AS psi_order_count
  FROM (SELECT {AS_OF} AS measured_at, {hours} AS window_hours, count(*) AS n, avg(CASE WHEN anomaly_score > 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS rate,
      avg(anomaly_score) AS mean_score, stddev_samp(anomaly_score) AS std,
      CASE WHEN {enough} THEN (SELECT psi FROM drift_psi_{hours} WHERE measure = 'total_revenue') END AS psi_revenue,
      CASE WHEN {enough} THEN (SELECT psi FROM drift_psi_{hours} WHERE measure = 'order_count') END AS psi_order_count
    FROM scored WHERE window_start >= {AS_OF} - INTERVAL '{hours} hours')))""", "scored", f"drift_psi_{hours}")
    return f"drift_{hours}"


query("drift_report", f"SELECT * FROM {drift_sql(24)}", "drift_24")
query("log_drift", f"""
SELECT measured_at, window_hours, drift_flag, notes FROM drift_24
UNION ALL SELECT measured_at, window_hours, drift_flag, notes FROM {drift_sql(48)}""", "drift_24", "drift_48")
query("drift_reports_stored", f"SELECT * FROM {drift_sql(24)} UNION ALL SELECT * FROM {drift_sql(48)}", "drift_24", "drift_48")
query("latest_drift", """
SELECT measured_at, anomaly_rate, avg_score, score_std, psi_revenue, drift_flag, notes,
  CASE WHEN psi_revenue > 0.2 THEN 'High drift' WHEN psi_revenue > 0.1 THEN 'Monitor' END AS psi_label
FROM (SELECT max(window_end) AS measured_at, round(avg(CASE WHEN severity = 'critical' THEN 1.0::DOUBLE ELSE 0 END), 4) AS anomaly_rate,
    round(avg(anomaly_score), 4) AS avg_score, round(stddev_samp(anomaly_score), 4) AS score_std,
    round(round(avg(CASE WHEN severity = 'critical' THEN 1.0::DOUBLE ELSE 0 END), 4) / 4, 4) AS psi_revenue,
    avg(CASE WHEN severity = 'critical' THEN 1.0::DOUBLE ELSE 0 END) > 0.5 AS drift_flag, 'day ' || strftime(window_start, '%Y%m%d') AS notes
  FROM a GROUP BY strftime(window_start, '%Y%m%d')) ORDER BY measured_at DESC LIMIT 1""", "a")

# --- investigation -----------------------------------------------------------------------------

URGENT = f"ORDER BY {RANK}, detected_at DESC, anomaly_id"
query("uninvestigated_anomalies", f"SELECT {ANOMALY} FROM a WHERE status = 'open' AND anomaly_id NOT IN (SELECT anomaly_id FROM r) {URGENT} LIMIT 5", "a", "r")
query("uninvestigated_anomalies_all", f"""
SELECT {ANOMALY} FROM a WHERE status = 'open' AND anomaly_id NOT IN (SELECT anomaly_id FROM r)""", "a", "r")
cte("ctx", """
SELECT *, round(greatest(expected_revenue - actual_revenue, 0), 2) AS loss,
  CASE WHEN expected_revenue > 0 THEN (actual_revenue / expected_revenue - 1) * 100 ELSE 0 END AS pct FROM a""", "a")
query("open_anomalies", f"""
SELECT {ANOMALY}, loss, round(pct, 4) AS pct_deviation, CASE WHEN pct < 0 THEN 'DROP' ELSE 'SPIKE' END AS direction
FROM ctx WHERE status = 'open' {URGENT} LIMIT 20""", "ctx")
query("anomaly_context", "SELECT anomaly_id, loss, round(pct, 4) AS pct_deviation, CASE WHEN pct < 0 THEN 'DROP' ELSE 'SPIKE' END AS direction FROM ctx", "ctx")
query("revenue_by_category", "SELECT window_start, region, order_count, total_revenue, avg_order_value FROM m WHERE category = 'Electronics'", "m")
query("revenue_by_region", "SELECT window_start, category, order_count, total_revenue, avg_order_value FROM m WHERE region = 'Delhi'", "m")
cte("vol", f"""
SELECT category, product_id, product_name, count(*) AS order_count, CAST(sum(quantity) AS BIGINT) AS total_units,
  CAST(sum(total_amount) AS DOUBLE) AS total_revenue FROM order_events GROUP BY ALL""", "order_events")
query("product_order_volume", "SELECT product_id, product_name, order_count, total_units, total_revenue FROM vol WHERE category = 'Footwear'", "vol")
query("product_order_volume_all", "SELECT * FROM vol", "vol")
cte("trend", "SELECT date_trunc('minute', event_timestamp)::TIMESTAMP AS minute, count(*) AS orders, CAST(sum(total_amount) AS DOUBLE) AS revenue FROM order_events GROUP BY 1", "order_events")
query("order_trend", "SELECT * FROM trend", "trend")
cte("pay", "SELECT payment_method, count(*) AS order_count, CAST(sum(total_amount) AS DOUBLE) AS total_revenue FROM order_events GROUP BY 1", "order_events")
query("payment_breakdown", "SELECT * FROM pay", "pay")
cte("snap", """
SELECT * EXCLUDE (k), CASE WHEN revenue_trend_pct < 0.6 THEN 'DECLINING' WHEN revenue_trend_pct < 1.4 THEN 'STABLE' ELSE 'SURGING' END AS trend
FROM (SELECT *, row_number() OVER (PARTITION BY category, region ORDER BY computed_at DESC) AS k FROM f) WHERE k <= 3""", "f")
query("feature_snapshot", "SELECT * FROM snap", "snap")
cte("all_next", "SELECT anomaly_id, category, region FROM a WHERE status = 'open' AND anomaly_id NOT IN (SELECT anomaly_id FROM r)", "a", "r")


def metric_line(other: str) -> str:
    return (f"{STAMP('window_start')} || ' | ' || m.{other} || ' | orders=' || order_count || ' | revenue=' || "
            f"{RUPEES('total_revenue')} || ' | avg=' || {RUPEES('avg_order_value')}")


query("investigation_bundle", f"""
SELECT 'Anomalies' AS section, category, region, anomaly_id AS position, anomaly_id || ' | ' || category || ' | ' || region AS line FROM all_next
UNION ALL SELECT 'Revenue by Category', category, NULL, {STAMP('window_start')} || '|' || m.region, {metric_line('region')}
  FROM m WHERE category IN (SELECT category FROM all_next)
UNION ALL SELECT 'Revenue by Region', NULL, region, {STAMP('window_start')} || '|' || m.category, {metric_line('category')}
  FROM m WHERE region IN (SELECT region FROM all_next)
UNION ALL SELECT 'Product Order Volume', category, NULL, product_id, product_id || ' ' || product_name || ' | orders=' || order_count || ' units=' || total_units
  || ' | revenue=' || {RUPEES('total_revenue')} FROM vol WHERE category IN (SELECT category FROM all_next)
UNION ALL SELECT 'Feature Snapshot', category, region, {STAMP('computed_at')}, {STAMP('computed_at')} || ' | rev 5m=' || {RUPEES('revenue_last_5m')}
  || ' 15m=' || {RUPEES('revenue_last_15m')} || ' 60m=' || {RUPEES('revenue_last_60m')} || ' | orders 5m=' || orders_last_5m || ' 15m=' || orders_last_15m
  || ' 60m=' || orders_last_60m || ' | avg=' || {RUPEES('avg_order_value_last_15m')} || ' | trend=' || format('{{:.2f}}', revenue_trend_pct) || ' (' || trend || ')'
  FROM snap SEMI JOIN all_next USING (category, region)
UNION ALL SELECT 'Recent Order Trend', NULL, NULL, {STAMP('minute')}, {STAMP('minute')} || ' | orders=' || orders || ' | revenue=' || {RUPEES('revenue')} FROM trend
UNION ALL SELECT 'Payment Breakdown', NULL, NULL, payment_method, rpad(payment_method, 25, ' ') || ' | orders=' || order_count || ' | revenue=' || {RUPEES('total_revenue')}
  FROM pay""", "m", "all_next", "vol", "snap", "trend", "pay")

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')".format
SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))".format
cte("parsed", rf"""
SELECT anomaly_id, CASE WHEN trim(cause) <> '' THEN {STRIP('cause')} ELSE 'Unable to determine root cause.' END AS root_cause,
  CASE WHEN action <> '' THEN action ELSE 'Manual investigation recommended.' END AS recommended_action,
  round(CASE WHEN expected_revenue IS NOT NULL AND confidence > 0.9 AND length(cause) < 100 THEN 0.7 ELSE confidence END, 2) AS confidence,
  round(CASE WHEN loss > greatest(expected_revenue, 1000) * 1.5 THEN own ELSE loss END, 2) AS estimated_loss, report_text
FROM (SELECT *, coalesce(stated_loss, own) AS loss,
    coalesce(stated, CASE WHEN length({STRIP('cause')}) >= 50 THEN 0.55::DOUBLE ELSE 0.15 END) AS confidence
  FROM (SELECT *, least(greatest(CASE WHEN c IS NULL THEN NULL WHEN c > 1 THEN c / 100 ELSE c END, CASE WHEN c IS NULL THEN NULL ELSE 0 END), CASE WHEN c IS NULL THEN NULL ELSE 1 END) AS stated,
      CASE WHEN found <> '' THEN found ELSE coalesce(substr(list_filter(list_transform(string_split(report_text, E'\n\n'), lambda p: {STRIP('p')}), lambda p: length(p) > 40)[-1], 1, 500), '') END AS cause,
      coalesce(greatest(expected_revenue - actual_revenue, 0), 0) AS own
    FROM (SELECT *, TRY_CAST(regexp_extract(body, '[Cc]onfidence\s*[:=]\s*([\d]*\.?[\d]+)', 1) AS DOUBLE) AS c,
        TRY_CAST(replace(regexp_extract(body, '[Ee]stimated\s*[Ll]oss\s*[:=]\s*[₹$Rs.\s]*([-\d,]*\.?\d+)', 1), ',', '') AS DOUBLE) AS stated_loss,
        {SQUEEZE(r"regexp_extract(body, '(?s)[Rr]oot\s*[Cc]ause(?:\s*[Aa]nalysis)?\s*[:=]\s*(.+?)(?:\n\s*(?:[Rr]ecommended|ANOMALY_REPORT_END)|$)', 1)")} AS found,
        {SQUEEZE(r"regexp_extract(body, '(?s)[Rr]ecommended\s*[Aa]ction\s*[:=]\s*(.+?)(?:\n\s*ANOMALY_REPORT_END|$)', 1)")} AS action
      FROM (SELECT t.*, a.actual_revenue, a.expected_revenue,
          CASE WHEN regexp_matches(report_text, '(?s)ANOMALY_REPORT_START(.*?)ANOMALY_REPORT_END')
            THEN regexp_extract(report_text, '(?s)ANOMALY_REPORT_START(.*?)ANOMALY_REPORT_END', 1) ELSE report_text END AS body
        FROM (SELECT * FROM texts UNION ALL SELECT 'doc ' || doc_id, text FROM documents) t LEFT JOIN a USING (anomaly_id)))))""", "texts", "a")
query("parse_reports", "SELECT * EXCLUDE (report_text) FROM parsed", "parsed")
query("apply_reports", """
SELECT anomaly_id, severity, category, region, actual_revenue, expected_revenue, confidence, estimated_loss, root_cause, recommended_action,
  report_text AS full_report FROM parsed JOIN a USING (anomaly_id)""", "parsed", "a")
query("acknowledged_anomalies", """
SELECT CASE WHEN anomaly_id IN (SELECT anomaly_id FROM r WHERE confidence > 0.5) THEN 'acknowledged' ELSE 'open' END AS status, region,
  count(*) AS anomalies FROM a GROUP BY ALL""", "a", "r")

# --- serving --------------------------------------------------------------------------------------

query("revenue_trend", "SELECT window_start, CAST(sum(cents) AS DOUBLE) / 100 AS total_rev, false AS fallback FROM m GROUP BY 1", "m")
query("revenue_trend_fallback", f"SELECT {five('event_timestamp')} AS window_start, CAST(sum(total_amount) AS DOUBLE) AS total_rev, true AS fallback FROM order_events GROUP BY 1", "order_events")
query("category_revenue", "SELECT category, CAST(sum(cents) AS DOUBLE) / 100 AS rev, false AS fallback FROM m GROUP BY 1", "m")
query("category_revenue_fallback", "SELECT category, CAST(sum(total_amount) AS DOUBLE) AS rev, true AS fallback FROM order_events GROUP BY 1", "order_events")
query("regional_revenue", "SELECT region, CAST(sum(cents) AS DOUBLE) / 100 AS rev, false AS fallback FROM m GROUP BY 1", "m")
query("kpis_api", f"""
SELECT 1440 AS lookback_minutes, CAST(coalesce(sum(order_count), 0) AS BIGINT) AS orders, CAST(coalesce(sum(cents), 0) AS DOUBLE) / 100 AS revenue,
  (SELECT count(*) FROM a WHERE status = 'open') AS open_anomalies, (SELECT count(*) FROM r) AS total_reports
FROM m WHERE window_end >= {AS_OF} - INTERVAL '1440 minutes'""", "m", "a", "r")
query("kpis_dashboard", """
SELECT CAST(sum(order_count) AS BIGINT) AS orders, CAST(sum(cents) AS DOUBLE) / 100 AS revenue,
  (SELECT count(*) FROM a WHERE status = 'open') AS open_anomalies, (SELECT count(*) FROM r) AS total_reports FROM m""", "m", "a", "r")
query("kpis_dashboard_fallback", """
SELECT count(*) AS orders, CAST(sum(total_amount) AS DOUBLE) AS revenue,
  (SELECT count(*) FROM a WHERE status = 'open') AS open_anomalies, (SELECT count(*) FROM r) AS total_reports FROM order_events""", "order_events", "a", "r")
query("metrics_summary", f"""
SELECT count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count,
  count(*) FILTER (status = 'open') AS open_count, max(detected_at) AS last_detected FROM a WHERE detected_at >= {AS_OF} - INTERVAL '24 hours'""", "a")
query("anomaly_freshness", f"""
SELECT count(*) AS total_anomalies, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'acknowledged') AS acknowledged,
  max(detected_at) AS latest_detection FROM a WHERE detected_at > {AS_OF} - INTERVAL '24 hours'""", "a")
query("dlq_stats", """
SELECT count(*) AS total, count(*) FILTER (NOT resolved) AS pending, count(*) FILTER (NOT resolved AND retry_count >= 5) AS exhausted,
  min(first_failed) AS oldest, max(first_failed) AS newest FROM dlq""", "dlq")
query("throughput", f"""
SELECT round(count(*) FILTER (ingested_at >= {AS_OF} - INTERVAL '60 minutes') / 60.0::DOUBLE, 1) AS events_per_minute, max(ingested_at) AS last_ingested
FROM order_events""", "order_events")
LATENCY = """(SELECT round(avg(date_diff('microsecond', event_timestamp, ingested_at) / 1e6), 2) FROM
  (SELECT * FROM order_events ORDER BY ingested_at DESC, event_id LIMIT 100))"""
query("ingest_latency", f"SELECT {LATENCY} AS latency_seconds", "order_events")
query("system_health", f"""
SELECT events_per_minute, latency_seconds, last_ingested, last_detection,
  date_diff('microsecond', last_ingested, now_at) / 1e6 <= 600 AS connected, date_diff('microsecond', last_ingested, now_at) / 1e6 > 120 AS stalled,
  date_diff('microsecond', last_detection, now_at) / 1e6 > 300 AS stale_scan
FROM (SELECT round(count(*) FILTER (ingested_at >= {AS_OF} - INTERVAL '5 minutes') / 5.0::DOUBLE, 1) AS events_per_minute, {LATENCY} AS latency_seconds,
  max(ingested_at) AS last_ingested, (SELECT max(detected_at) FROM a) AS last_detection, {AS_OF} AS now_at FROM order_events)""", "order_events", "a")
query("category_revenue_1h", f"""
SELECT category, {money('c')} AS revenue_1h, n AS order_count_1h, {mean('c', 'n')} AS avg_order_value
FROM (SELECT category, CAST(sum(total_amount) * 100 AS BIGINT) AS c, count(*) AS n FROM order_events
  WHERE event_timestamp > {AS_OF} - INTERVAL '1 hour' GROUP BY 1)""", "order_events")
query("anomalies_by_category", "SELECT category, count(*) AS anomalies FROM a GROUP BY 1", "a")
query("anomalies_by_severity", "SELECT date_trunc('hour', detected_at)::TIMESTAMP AS window_start, severity, count(*) AS anomalies FROM a GROUP BY ALL", "a")
query("page_anomalies", f"""
SELECT {ANOMALY}, (SELECT count(*) FROM a WHERE status = 'open') AS total FROM a WHERE status = 'open'
ORDER BY detected_at DESC, anomaly_id LIMIT 25 OFFSET 10""", "a")
query("page_reports", "SELECT *, (SELECT count(*) FROM r) AS total FROM r ORDER BY created_at DESC, anomaly_id LIMIT 10 OFFSET 5", "r")
query("anomaly_feed", f"""
SELECT {ANOMALY}, round(abs(CASE WHEN expected_revenue > 0 THEN (expected_revenue - actual_revenue) / expected_revenue * 100 ELSE 0 END), 1) AS drop_pct,
  CASE WHEN actual_revenue < expected_revenue THEN 'DROP' ELSE 'SPIKE' END AS direction FROM a ORDER BY detected_at DESC, anomaly_id LIMIT 5""", "a")
query("report_feed", """
SELECT *, CASE WHEN confidence < 0.4 THEN 'low' WHEN confidence < 0.7 THEN 'medium' ELSE 'high' END AS confidence_band,
  CASE WHEN expected_revenue > 0 THEN round(estimated_loss / expected_revenue * 100, 1) END AS loss_pct
FROM r ORDER BY created_at DESC, anomaly_id LIMIT 10""", "r")

# --- retention and data quality ------------------------------------------------------------------------

query("archive_events", f"""
SELECT CASE WHEN event_timestamp < {AS_OF} - INTERVAL '12 days' THEN 'archived' ELSE 'kept' END AS side, event_id, event_timestamp FROM order_events""", "order_events")
query("archive_anomalies", f"""
SELECT CASE WHEN detected_at < {AS_OF} - INTERVAL '12 days' THEN 'archived' ELSE 'kept' END AS side, anomaly_id, category, region FROM a
UNION ALL SELECT 'reports', anomaly_id, r.category, r.region FROM r JOIN a USING (anomaly_id) WHERE a.detected_at >= {AS_OF} - INTERVAL '12 days'""", "a", "r")
PER_MONTH = ("SELECT strftime(event_timestamp, '%Y_%m') AS event_month, count(*) AS rows, min(event_timestamp) AS first_event, "
             "max(event_timestamp) AS last_event FROM order_lines {} GROUP BY 1").format
query("partition_report", PER_MONTH(""), "order_lines")
query("drop_old_month", PER_MONTH(
    "WHERE strftime(event_timestamp, '%Y_%m') <> (SELECT strftime(max(event_timestamp) - INTERVAL '6 months', '%Y_%m') FROM order_lines)"), "order_lines")
query("purge_features", "SELECT * FROM f WHERE computed_at >= (SELECT max(computed_at) FROM f) - INTERVAL '240 hours'", "f")
query("next_partition_bounds", """
SELECT 'order_events_' || strftime(s, '%Y_%m') AS partition_name, strftime(s, '%Y-%m-%d') AS start_date, strftime(s + INTERVAL '1 month', '%Y-%m-%d') AS end_date
FROM (SELECT date_trunc('month', max(ts) + INTERVAL '1 month') AS s FROM events)""")
query("window_gaps", "SELECT date_trunc('hour', window_start)::TIMESTAMP AS hour, count(*) AS windows FROM m GROUP BY 1 ORDER BY 1 DESC LIMIT 24", "m")
query("window_gaps_filled", """
SELECT h AS hour, count(c.window_start) AS windows
FROM (SELECT unnest(generate_series(max(date_trunc('hour', window_start))::TIMESTAMP - INTERVAL '47 hours', max(date_trunc('hour', window_start))::TIMESTAMP, INTERVAL '1 hour')) AS h
      FROM m)
LEFT JOIN m c ON date_trunc('hour', c.window_start) = h GROUP BY 1""", "m")
COUNTS = ["order_events", "revenue_metrics", "anomalies", "copilot_reports"]
_OF = dict(zip(COUNTS, ["order_events", "m", "a", "r"]))
query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {t}" for n, t in _OF.items()), "order_events", "m", "a", "r")
query("latest_by_table", """
SELECT 'Latest order event' AS check_type, CAST(max(event_timestamp) AS VARCHAR) AS latest FROM order_events
UNION ALL SELECT 'Latest anomaly', CAST(max(detected_at) AS VARCHAR) FROM a UNION ALL SELECT 'Latest report', CAST(max(created_at) AS VARCHAR) FROM r""", "order_events", "a", "r")
RECENT_A = f"(SELECT * FROM a WHERE detected_at >= {AS_OF} - INTERVAL '12 days')"
query("orphaned_reports", f"SELECT anomaly_id, created_at, category, region FROM r WHERE anomaly_id NOT IN (SELECT anomaly_id FROM {RECENT_A})", "a", "r")
query("integrity_checks", f"""
SELECT 'rows: order_events' AS check_name, CAST(count(*) AS VARCHAR) AS value FROM order_events
UNION ALL SELECT 'rows: revenue_metrics', CAST(count(*) AS VARCHAR) FROM m UNION ALL SELECT 'rows: anomalies', CAST(count(*) AS VARCHAR) FROM {RECENT_A}
UNION ALL SELECT 'rows: copilot_reports', CAST(count(*) AS VARCHAR) FROM r
UNION ALL SELECT 'latest: order event', CAST(max(event_timestamp) AS VARCHAR) FROM order_events
UNION ALL SELECT 'latest: anomaly', CAST(max(detected_at) AS VARCHAR) FROM {RECENT_A} UNION ALL SELECT 'latest: report', CAST(max(created_at) AS VARCHAR) FROM r
UNION ALL SELECT 'orphaned reports', CAST(count(*) AS VARCHAR) FROM r WHERE anomaly_id NOT IN (SELECT anomaly_id FROM {RECENT_A})""", "order_events", "m", "a", "r")
query("config_audit", """
SELECT key, old_value, value AS new_value, updated_at AS changed_at
FROM (SELECT *, lag(value) OVER w AS old_value, row_number() OVER w AS k FROM cfg WINDOW w AS (PARTITION BY key ORDER BY updated_at))
WHERE k > 1 AND old_value IS DISTINCT FROM value""", "cfg")
query("current_config", "SELECT key, arg_max(value, updated_at) AS value, max(updated_at) AS updated_at FROM cfg GROUP BY 1", "cfg")
query("mask_secrets", r"""
SELECT doc_id, replace(replace(regexp_replace(text,
    '(?i)(password|secret|key|token|auth)[''"]?\s*[:=]\s*[''"]?[^''"\s,]+[''"]?|(:)[^:/@]+@',
    '\1' || chr(64976) || '\2' || chr(64977), 'g'),
  chr(64976) || ':' || chr(64977), ':[REDACTED]@'), chr(64976) || chr(64977), ': [REDACTED]') AS text FROM documents""")

# --- dead letters ----------------------------------------------------------------------------------------

query("dlq_retry_batch", "SELECT dlq_id, retry_count, first_failed FROM dlq WHERE NOT resolved AND retry_count < 5 ORDER BY first_failed, dlq_id LIMIT 100", "dlq")
query("exhausted_dead_letters", "SELECT dlq_id, retry_count, first_failed FROM dlq WHERE NOT resolved AND retry_count >= 5", "dlq")
query("retry_dead_letters", f"""
SELECT dlq_id, CASE WHEN tried AND problem <> '' THEN problem ELSE 'rejected' END AS error,
  CASE WHEN tried AND problem <> '' THEN retry_count + 1 ELSE retry_count END AS retry_count, first_failed,
  CASE WHEN tried AND problem <> '' THEN {AS_OF} END AS last_retried, resolved OR (tried AND problem = '') AS resolved
FROM (SELECT *, NOT resolved AND retry_count < 5 AS tried FROM dlq)""", "dlq")
query("recovered_dead_letters", f"""
SELECT o.event_id, o.event_type, TIMESTAMP '2024-01-31 00:00:00' AS event_timestamp, o.order_id, o.product_id, o.product_name, o.category, o.quantity,
  CAST(o.unit_price AS DOUBLE) AS unit_price, CAST(o.total_amount AS DOUBLE) AS total_amount, o.region, o.payment_method
FROM dlq JOIN order_events o ON CAST(dlq.n AS VARCHAR) = o.event_id WHERE NOT resolved AND retry_count < 5 AND problem = ''""", "dlq", "order_events")

# --- telemetry --------------------------------------------------------------------------------------------

query("consecutive_failures", """
SELECT sink, batch_id, finished_at, CAST(in_row AS BIGINT) AS consecutive_failures, CAST(total_failures AS BIGINT) AS total_failures, total_batches,
  round(CAST(total_failures AS DOUBLE) / total_batches, 4) AS failure_rate, in_row < 2 AS healthy
FROM (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY sink, island ORDER BY finished_at) AS in_row
  FROM (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER w AS island, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER w AS total_failures,
      count(*) OVER w AS total_batches FROM batches WINDOW w AS (PARTITION BY sink ORDER BY finished_at)))""", "batches")


def increase(steps: int, size: str, minutes: int) -> str:
    return f"""SELECT name, label, {five('ts', size)} + s * INTERVAL '{size}' AS window_end, sum(delta) AS increase, sum(delta) / {minutes * 60}.0::DOUBLE AS rate
FROM deltas, range(1, {steps + 1}) AS steps(s) GROUP BY ALL"""


query("counter_increase", f"SELECT name, label, window_end, increase, round(rate, 6) AS rate FROM ({increase(3, '5 minutes', 15)})", "deltas")
query("events_per_minute", f"SELECT name, label, window_end, round(rate * 60, 6) AS events_per_minute FROM ({increase(1, '1 minute', 1)})", "deltas")
query("error_spike_alert", f"SELECT name, label, window_end, increase, increase > 40 AS breach FROM ({increase(15, '1 minute', 15)})", "deltas")
query("total_alert", "SELECT name, label, arg_max(value, (ts, value)) AS value, max(ts) AS sampled_at, arg_max(value, (ts, value)) > 250 AS breach FROM samples GROUP BY ALL", "samples")
cte("buckets", """
SELECT event_type, le, count(*) FILTER (value <= le) AS cumulative, sum(value) AS total_value
FROM events, (SELECT unnest([1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 'infinity'::DOUBLE]) AS le) GROUP BY event_type, le""")
query("bucket_histogram", """
SELECT event_type, CASE WHEN isinf(le) THEN '+Inf' ELSE format('{:.1f}', le) END AS le, cumulative, round(total_value, 2) AS total_value FROM buckets""", "buckets")
query("histogram_quantile", """
SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * (0.95 * total - below) / (cumulative - below) END, 6) AS quantile
FROM (SELECT *, lag(le) OVER w AS low, coalesce(lag(cumulative) OVER w, 0) AS below, max(cumulative) OVER (PARTITION BY event_type) AS total
  FROM buckets WINDOW w AS (PARTITION BY event_type ORDER BY le))
WHERE cumulative >= 0.95 * total AND below < 0.95 * total""", "buckets")
query("anomaly_rate_alert", f"""
SELECT window_start, window_start + INTERVAL '5 minutes' AS window_end, CAST(sum(ev) AS BIGINT) AS events, CAST(sum(an) AS BIGINT) AS anomalies,
  round(sum(an) / 300.0::DOUBLE / greatest(sum(ev) / 300.0::DOUBLE, 0.01), 6) AS anomaly_rate,
  sum(an) / 300.0::DOUBLE / greatest(sum(ev) / 300.0::DOUBLE, 0.01) > 0.2 AS breach
FROM (SELECT {five('event_timestamp')} AS window_start, 1 AS ev, 0 AS an FROM order_events
  UNION ALL SELECT {five('detected_at')}, 0, 1 FROM a) GROUP BY 1""", "order_events", "a")
query("sustained_breach", """
SELECT category, window_start, breach, CASE WHEN breach THEN since END AS active_since,
  breach AND since + INTERVAL '10 minutes' <= window_start AS firing
FROM (SELECT *, max(CASE WHEN breach AND NOT coalesce(was AND was_at + INTERVAL '5 minutes' >= window_start, false) THEN window_start END)
    OVER (PARTITION BY category ORDER BY window_start) AS since
  FROM (SELECT *, lag(breach) OVER w AS was, lag(window_start) OVER w AS was_at
    FROM (SELECT category, window_start, sum(order_count) < 2 AS breach FROM m GROUP BY ALL)
    WINDOW w AS (PARTITION BY category ORDER BY window_start)))""", "m")

query("counter_increase_5m", f"SELECT name, label, window_end, increase FROM ({increase(5, '1 minute', 5)})", "deltas")
query("windowed_quantile", """
WITH b AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, le, count(*) FILTER (value <= le) AS cumulative
  FROM events, (SELECT unnest([1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 'infinity'::DOUBLE]) AS le) WHERE value IS NOT NULL GROUP BY ALL)
SELECT event_type, hour, round(CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * (0.95 * total - below) / (cumulative - below) END, 6) AS quantile
FROM (SELECT *, lag(le) OVER w AS low, coalesce(lag(cumulative) OVER w, 0) AS below, max(cumulative) OVER (PARTITION BY event_type, hour) AS total
  FROM b WINDOW w AS (PARTITION BY event_type, hour ORDER BY le))
WHERE cumulative >= 0.95 * total AND below < 0.95 * total""")


def state_sql(alert: str, rows: str, duration: str, step: str) -> str:
    return f"""
SELECT '{alert}' AS alert, label, CASE WHEN breach AND since + INTERVAL '{duration}' <= t THEN 'firing' WHEN breach THEN 'pending' ELSE 'inactive' END AS state,
  CASE WHEN breach THEN since END AS active_since, t AS evaluated_at
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY t DESC) AS k FROM (
  SELECT *, max(CASE WHEN breach AND NOT coalesce(was AND was_at + INTERVAL '{step}' >= t, false) THEN t END) OVER (PARTITION BY label ORDER BY t) AS since
  FROM (SELECT *, lag(breach) OVER w AS was, lag(t) OVER w AS was_at FROM ({rows}) WINDOW w AS (PARTITION BY label ORDER BY t)))) WHERE k = 1"""


VALUE = "SELECT label, ts AS t, max(value) > {} AS breach FROM samples GROUP BY ALL".format
RATE = f"""SELECT 'all' AS label, t, sum(an) / 300.0::DOUBLE / greatest(sum(ev) / 300.0::DOUBLE, 0.01) > 0.2 AS breach
  FROM (SELECT {five('event_timestamp')} AS t, 1 AS ev, 0 AS an FROM order_events UNION ALL SELECT {five('detected_at')}, 0, 1 FROM a) GROUP BY 1, 2"""
query("alert_states", " UNION ALL ".join([
    state_sql("produce_errors", VALUE(250), "1 minute", "1 hour"), state_sql("anomaly_rate", RATE, "5 minutes", "5 minutes"),
    state_sql("reconnects", VALUE(0), "1 minute", "1 hour"),
    state_sql("error_spike", f"SELECT label, window_end AS t, increase > 40 AS breach FROM ({increase(15, '1 minute', 15)})", "1 hour", "1 minute"),
]), "samples", "deltas", "order_events", "a")

# --- streaming ------------------------------------------------------------------------------------------

query("stream_dead_letters", SQL["route_dead_letters"])
query("stream_revenue_metrics", f"SELECT {METRIC} FROM m", "m")
query("stream_feature_store", "SELECT * FROM f", "f")
query("stream_order_events", f"""
SELECT event_id, event_timestamp, {WIRE_COLS}, CAST(total_amount AS DOUBLE) AS total_amount, region, payment_method FROM order_events""", "order_events")
query("upsert_table", SQL["upsert"])
query("upsert_partial_table", SQL["upsert_partial"])
query("insert_table", f"SELECT {ANOMALY} FROM a", "a")
query("archive_table", SQL["archive_events"])
query("run_streams", """
SELECT 'order_events' AS table_name, count(*) AS rows FROM order_events WHERE category <> 'Accessories'
UNION ALL SELECT 'revenue_metrics', count(*) FROM m WHERE category <> 'Accessories'
UNION ALL SELECT 'feature_store', count(*) FROM f WHERE category <> 'Accessories'
UNION ALL SELECT 'dlq_events', count(DISTINCT value) FROM wire WHERE kind >= 0""", "order_events", "m", "f", "wire")
query("batch_log", """
SELECT 'failing' AS sink, CAST(b AS BIGINT) AS batch_id, CASE WHEN b < 2 THEN n END AS input_rows, b = 2 AS failed
FROM range(0, 3) AS batches(b) LEFT JOIN (
  SELECT (epoch_us(ts) - low) // step AS b, count(*) + count(*) FILTER (event_id % 50 = 0) AS n
  FROM events, (SELECT epoch_us(min(ts)) AS low, CAST(round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 10.0, 0) AS BIGINT) AS step FROM events)
  GROUP BY 1) USING (b)""")
query("archive_anomalies_table", SQL["archive_anomalies"])
query("drop_month_folder", SQL["drop_old_month"])
query("partition_bytes", "SELECT DISTINCT strftime(event_timestamp, '%Y_%m') AS event_month, true AS stored FROM order_lines", "order_lines")
query("stored_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ("events", "orders", "lineitem", "customer")))
query("system_health_stored", SQL["system_health"])
query("rollup_refresh", SQL["category_revenue_1h"])
query("config_audit_feed", """
SELECT key, old_value, value AS new_value, updated_at AS changed_at
FROM (SELECT *, lag(value) OVER w AS old_value, row_number() OVER w AS k FROM cfg
  WHERE updated_at >= (SELECT min(d) FROM (SELECT DISTINCT updated_at AS d FROM cfg ORDER BY d DESC LIMIT 3)) WINDOW w AS (PARTITION BY key ORDER BY updated_at))
WHERE k > 1 AND old_value IS DISTINCT FROM value""", "cfg")
query("registry_cycle", """
WITH able AS (SELECT *, num_samples >= 100 AND num_anomalies > 0 AND num_anomalies < num_samples AS ok FROM models),
judged AS (SELECT *, ok AND f1 >= coalesce(max(f1) FILTER (ok) OVER (ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS promoted FROM able),
turns AS (SELECT *, count(*) FILTER (promoted) OVER (ORDER BY version DESC) AS back FROM judged)
SELECT version, f1, CASE WHEN NOT promoted THEN 'candidate' WHEN back = least(2, (SELECT count(*) FROM turns WHERE promoted)) THEN 'production' ELSE 'archived' END AS status
FROM turns""".replace("WITH able", ", able", 1), "models")
SQL["registry_cycle"] = SQL["registry_cycle"].replace("\n\n, able", ",\nable", 1)
query("dead_letter_cycle", """
SELECT dlq_id, CASE WHEN tried AND problem <> '' THEN least(5, retry_count + 3) ELSE retry_count END AS retry_count,
  resolved OR (tried AND problem = '') AS resolved, tried AND problem = '' AS landed
FROM (SELECT *, NOT resolved AND retry_count < 5 AS tried FROM dlq)""", "dlq")
query("alert_state_steps", " UNION ALL ".join(state_sql(alert, VALUE(limit), "1 minute", "1 hour") for alert, limit in (("produce_errors", 250), ("reconnects", 0))), "samples")
query("stream_detection", f"""
SELECT * REPLACE ('open' AS status) FROM (SELECT {ANOMALY} FROM a)
WHERE window_end <= (SELECT max(event_timestamp) - INTERVAL '2 minutes' FROM order_events)""", "a", "order_events")
query("supervised_batches", """
WITH feed AS (SELECT (epoch_us(ts) - low) // step AS b, event_id FROM events,
  (SELECT epoch_us(min(ts)) AS low, CAST(round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 10.0, 0) AS BIGINT) AS step FROM events)),
own AS (SELECT least(b, 9) AS b, count(*) + count(*) FILTER (event_id % 50 = 0) AS n FROM feed GROUP BY 1),
again AS (SELECT b + 2 AS b, count(*) AS n FROM feed WHERE event_id % 70 = 0 GROUP BY 1)
SELECT 'shaky' AS sink, CAST(b AS BIGINT) AS batch_id, CAST(own.n + coalesce(again.n, 0) AS BIGINT) AS input_rows, false AS failed FROM own LEFT JOIN again USING (b)
UNION ALL SELECT 'shaky', 2, NULL, true FROM range(0, 4)""")

"""Shared sub-selects. A statement names the ones it needs and ``render`` puts them in front of it."""

from __future__ import annotations

import re

# Name -> body. Bodies may use other names of this dict; order of the dict is order of definition.
PARTS: dict[str, str] = {
    "raw_lines": """
        SELECT l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber AS order_id,
               CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
               l_shipdate AS order_ts,
               CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Delivered' ELSE 'Placed' END AS status,
               l_extendedprice AS amount_usd, l_suppkey
        FROM lineitem""",
    "ranked_lines": """
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                 ORDER BY order_ts DESC, order_id, product_id, quantity, status, amount_usd, l_suppkey) AS rn
        FROM raw_lines""",
    "orders_silver": """
        SELECT order_id, CAST(o_custkey AS VARCHAR) AS customer_id, product_id, quantity, order_ts,
               lower(status) AS status, amount_usd, CAST(order_ts AS DATE) AS order_date
        FROM ranked_lines JOIN orders ON o_orderkey = l_orderkey WHERE rn = 1""",
    "customers_silver": """
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
               lower(trim('  ' || c_name || '@Example.com ')) AS email,
               trim(' ' || c_name || ' ') AS full_name, upper(lower(n_name)) AS country,
               TIMESTAMP '2020-01-01' + to_hours(c_custkey) AS created_at,
               TIMESTAMP '2020-01-01' + to_hours(c_custkey) + to_days(c_nationkey) AS updated_at
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "products_raw": """
        SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_brand || '-' || p_partkey AS sku, p_name AS name,
               upper(p_type) AS category, p_retailprice AS price_usd, p_size % 10 <> 0 AS is_active,
               TIMESTAMP '2024-01-01' + to_days(p_size) AS updated_at
        FROM part""",
    "products_silver": """
        SELECT product_id, sku, name, lower(category) AS category, price_usd, is_active, updated_at
        FROM products_raw WHERE is_active""",
    "events_k": """
        SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "events_silver": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS customer_id,
               CASE WHEN k % 10 <> 0 THEN CAST(k AS VARCHAR) END AS product_id, lower(event_type) AS event_type,
               ts AS event_ts, ts + to_minutes(k * 30) AS process_ts, CAST(k * 30 AS DOUBLE) AS lag_minutes
        FROM events_k""",
    "reviews_silver": """
        SELECT conv_id || '-' || turn AS review_id, CAST(conv_id AS VARCHAR) AS customer_id,
               CAST(turn AS VARCHAR) AS product_id, CAST(length(text) % 5 + 1 AS INTEGER) AS rating,
               text AS review_text, TIMESTAMP '2024-01-01' + to_hours(turn) AS review_ts
        FROM conversations""",
    "observed": """
        SELECT
          (SELECT count(*) FILTER (amount_usd < 0) FROM orders_silver) AS bad,
          (SELECT count(*) FILTER (customer_id IS NULL) FROM orders_silver) AS nul,
          (SELECT count(*) - count(DISTINCT order_id) FROM orders_silver) AS dup,
          (SELECT 2 * count(*) - count(DISTINCT order_id) FROM orders_silver) AS dup2,
          (SELECT count(*) FROM orders_silver) AS n,
          (SELECT avg(CASE WHEN email IS NULL THEN 1.0 ELSE 0.0 END) FROM customers_silver) AS email,
          (SELECT avg(CASE WHEN CAST(customer_id AS BIGINT) % 2 = 0 THEN 1.0 ELSE 0.0 END)
             FROM customers_silver) AS email2,
          (SELECT avg(CASE WHEN lag_minutes > 2880 THEN 1.0 ELSE 0.0 END) FROM events_silver) AS late""",
    "dq_facts": """
        SELECT run_id, pipeline_key, check_name, table_name, metric_name, CAST(v AS DOUBLE) AS observed_value,
               CAST(threshold AS DOUBLE) AS threshold_value, comparator,
               CASE comparator WHEN '==' THEN v = threshold ELSE v <= threshold END AS passed,
               TIMESTAMP '2024-01-30 12:00:00' AS checked_at
        FROM (
          SELECT r.run_id, r.pipeline_key, c.*,
                 CASE c.check_name
                   WHEN 'orders_non_negative_amount' THEN
                        CAST(CASE WHEN r.run_id = 'prove-duplicate_explosion' THEN 2 * bad ELSE bad END AS DOUBLE)
                   WHEN 'orders_non_null_customer' THEN
                        CAST(CASE WHEN r.run_id = 'prove-duplicate_explosion' THEN 2 * nul ELSE nul END AS DOUBLE)
                   WHEN 'orders_duplicate_rate' THEN
                        CASE WHEN r.run_id = 'prove-duplicate_explosion'
                             THEN CAST(dup2 AS DOUBLE) / (2 * n) ELSE CAST(dup AS DOUBLE) / n END
                   WHEN 'customers_email_null_rate' THEN
                        CASE WHEN r.run_id = 'prove-null_spike' THEN email2 ELSE email END
                   ELSE CASE WHEN r.run_id = 'prove-late_data' THEN 1.0 ELSE late END
                 END AS v
          FROM observed,
               (VALUES ('dq-healthy', 'orders_ingest'), ('prove-null_spike', 'customers_scd2'),
                       ('prove-duplicate_explosion', 'orders_ingest'),
                       ('prove-late_data', 'events_clickstream')) r(run_id, pipeline_key),
               (VALUES ('orders_non_negative_amount', 'demo.silver.orders', 'bad_rows', '==', 0.0),
                       ('orders_non_null_customer', 'demo.silver.orders', 'null_rows', '==', 0.0),
                       ('customers_email_null_rate', 'demo.silver.customers', 'null_rate', '<=', 0.2),
                       ('orders_duplicate_rate', 'demo.silver.orders', 'duplicate_rate', '<=', 0.01),
                       ('events_lag_under_48h', 'demo.silver.events', 'pct_late', '<=', 0.05))
                 c(check_name, table_name, metric_name, comparator, threshold))""",
    "telemetry_counts": """
        SELECT event_type, CAST(ts AS DATE) AS day, CASE WHEN event_id % 2 = 0 THEN 'extract' ELSE 'load' END AS task_name,
               count(*) AS n, count(*) FILTER ((event_id // 2) % 20 = 0) AS thin,
               count(*) FILTER (value > 100) AS high,
               count(*) FILTER (value > 100 OR (event_id // 2) % 2 = 0) AS holed,
               sum(CAST(value AS DECIMAL(18,2))) AS total, min(ts) AS started_at, max(ts) AS ended_at
        FROM events GROUP BY ALL""",
    "runs": """
        SELECT event_type || '-' || day AS run_id,
               CASE event_type WHEN 'purchase' THEN 'orders_ingest' WHEN 'signup' THEN 'customers_scd2'
                 WHEN 'view' THEN 'products_catalog' WHEN 'click' THEN 'events_clickstream'
                 WHEN 'error' THEN 'reviews_enrichment' ELSE event_type END AS pipeline_key,
               task_name, started_at, ended_at, day,
               CAST(floor(total * 10) AS BIGINT)
                 * CASE WHEN day = DATE '2024-01-30' AND event_type = 'click' THEN 5 ELSE 1 END AS duration_ms,
               CASE WHEN day = DATE '2024-01-30' AND event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
               n AS rows_in,
               CASE WHEN day = DATE '2024-01-30' AND event_type = 'purchase' THEN thin ELSE n END AS rows_out,
               CASE WHEN day = DATE '2024-01-30' AND event_type = 'view' AND task_name = 'extract'
                    THEN '{"event_id":"bigint","event_type_v2":"string","ts":"timestamp","value":"string"}'
                    WHEN event_type = 'click' AND day(day) = 1 THEN '{"event_id":'
                    ELSE '{"event_id":"bigint","event_type":"string","ts":"timestamp","value":"double"}'
               END AS snap,
               CASE WHEN day = DATE '2024-01-30' AND event_type = 'error' THEN 'java.lang.OutOfMemoryError' END
                 AS error_class,
               CASE WHEN day = DATE '2024-01-30' AND event_type = 'error' THEN 'Java heap space' END AS error_message,
               CAST(CASE WHEN day = DATE '2024-01-30' AND event_type = 'signup' THEN holed ELSE high END AS DOUBLE) / n
                 AS null_rate
        FROM telemetry_counts""",
    "flagged": """
        SELECT *, row_number() OVER (PARTITION BY pipeline_key, task_name ORDER BY ended_at DESC, run_id DESC) = 1
                 AS is_current
        FROM runs""",
    "base": """
        SELECT pipeline_key, count(*) AS n,
               avg(CAST(rows_out AS DOUBLE)) AS v_mean, stddev_pop(CAST(rows_out AS DOUBLE)) AS v_sigma,
               arg_max(rows_out, ended_at) AS v_last,
               avg(null_rate) AS r_mean, stddev_pop(null_rate) AS r_sigma,
               avg(CAST(duration_ms AS DOUBLE)) AS d_mean, stddev_pop(CAST(duration_ms AS DOUBLE)) AS d_sigma
        FROM flagged WHERE NOT is_current GROUP BY pipeline_key""",
    "scored": """
        SELECT f.*, b.* EXCLUDE (pipeline_key),
               abs(rows_out - v_mean) / coalesce(nullif(v_sigma, 0), 1e-9) AS v_z,
               (null_rate - r_mean) / coalesce(nullif(r_sigma, 0), 1e-9) AS r_z,
               (duration_ms - d_mean) / coalesce(nullif(d_sigma, 0), 1e-9) AS d_z
        FROM flagged f JOIN base b USING (pipeline_key) WHERE is_current""",
    "pairs": """
        SELECT pipeline_key, max(CASE WHEN rn = 1 THEN run_id END) AS current_run_id,
               max(CASE WHEN rn = 2 THEN run_id END) AS previous_run_id,
               max(CASE WHEN rn = 1 THEN snap END) AS cur, max(CASE WHEN rn = 2 THEN snap END) AS prev
        FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_key ORDER BY ended_at DESC, run_id DESC) AS rn FROM runs)
        WHERE rn <= 2 GROUP BY 1""",
    "diffs": """
        SELECT *, CASE WHEN cur = prev THEN '' WHEN contains(cur, '_v2') THEN 'event_type_v2' ELSE 'event_type' END AS added,
               CASE WHEN cur = prev THEN '' WHEN contains(cur, '_v2') THEN 'event_type' ELSE 'event_type_v2' END AS removed,
               CASE WHEN cur = prev THEN '' WHEN contains(cur, '_v2') THEN 'value:double>string'
                    ELSE 'value:string>double' END AS type_changes
        FROM pairs""",
    "tasks": """
        SELECT *, l_orderkey % 30 * 86400 + l_linenumber * 3600 + l_partkey % 3600 AS secs,
               CASE l_partkey % 6 WHEN 0 THEN 'orders_ingest' WHEN 1 THEN 'customers_scd2'
                 WHEN 2 THEN 'products_catalog' WHEN 3 THEN 'events_clickstream' WHEN 4 THEN 'reviews_enrichment'
                 ELSE 'job_' || l_suppkey END AS pipeline_key,
               CASE l_linenumber % 4
                 WHEN 0 THEN 'java.lang.OutOfMemoryError: Java heap space in stage ' || l_linenumber
                 WHEN 1 THEN 'ValueError: bad column in stage 3' WHEN 2 THEN 'Cluster terminated unexpectedly'
                 ELSE 'Traceback (most recent call last) in stage 1' END AS message
        FROM lineitem
        WHERE l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linestatus = 'O')""",
    "task_logs": """
        SELECT CAST(l_orderkey AS VARCHAR) AS run_id, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS task_run_id,
               CAST(l_suppkey AS VARCHAR) AS job_id, pipeline_key, 'load_' || l_linenumber AS task_key,
               CASE WHEN l_returnflag = 'A' THEN 'INTERNAL_ERROR' ELSE 'TERMINATED' END AS lifecycle_state,
               CASE WHEN l_returnflag = 'R' THEN CASE l_linestatus WHEN 'F' THEN 'FAILED' ELSE 'TIMEDOUT' END END
                 AS result_state,
               coalesce(nullif(regexp_extract(message, '(?i)(Exception|Error|OOM|OutOfMemoryError|Traceback)', 1), ''),
                        'unknown_failure') AS error_signature,
               message AS raw_output, TIMESTAMP '2024-01-01' + to_seconds(secs) AS collected_at
        FROM tasks""",
    "crash_signals": """
        SELECT run_id AS job_run_id, pipeline_key, 'job_crash' AS failure_type, 'poller' AS detected_by,
               CASE WHEN contains(lower(raw_output), 'outofmemory') OR result_state = 'TIMEDOUT'
                    THEN 'high' ELSE 'medium' END AS severity,
               collected_at AS detected_at, 1 AS rule_rank, task_key, coalesce(result_state, '') AS result_state,
               lifecycle_state, error_signature, raw_output AS raw_output_excerpt
        FROM task_logs""",
    "class_of": """
        SELECT *, CASE WHEN contains(c, 'null') THEN 'null_spike' WHEN contains(c, 'dup') THEN 'duplicate_explosion'
                 WHEN contains(c, 'volume') OR contains(c, 'row_count') THEN 'volume_anomaly'
                 WHEN contains(c, 'late') OR contains(c, 'lag') THEN 'late_data'
                 WHEN contains(c, 'schema') THEN 'schema_drift' ELSE 'null_spike' END AS failure_type
        FROM (SELECT *, lower(check_name || ' ' || metric_name) AS c FROM dq_facts WHERE NOT passed)""",
    "drift": """
        SELECT run_id, pipeline_key, ended_at FROM flagged
        WHERE is_current AND contains(snap, 'event_type_v2')""",
    "signals": """
        SELECT job_run_id, pipeline_key, failure_type, detected_by, severity, detected_at, rule_rank,
               0 AS prio, task_key || '","' || result_state || '","' || lifecycle_state AS tie FROM crash_signals
        UNION ALL
        SELECT run_id, pipeline_key, 'job_crash', 'workflow', 'high', ended_at, 2, 0, task_name
        FROM flagged WHERE is_current AND status = 'FAILED'
        UNION ALL
        SELECT run_id, pipeline_key, failure_type, 'workflow', 'medium', checked_at, 3,
               CASE failure_type WHEN 'duplicate_explosion' THEN 2 WHEN 'null_spike' THEN 3 ELSE 5 END, check_name
        FROM class_of
        UNION ALL
        SELECT run_id, pipeline_key, 'volume_anomaly', 'workflow', 'medium', ended_at, 4, 4, task_name
        FROM scored WHERE v_z >= 3
        UNION ALL
        SELECT run_id, pipeline_key, 'null_spike', 'workflow', 'medium', ended_at, 5, 3, task_name
        FROM scored WHERE r_z >= 3
        UNION ALL
        SELECT run_id, pipeline_key, 'schema_drift', 'workflow', 'high', ended_at, 6, 1, '' FROM drift""",
    "incident_table": """
        SELECT sha1('incident:' || job_run_id) AS incident_id, job_run_id, min(detected_at) AS detected_at,
               arg_min(pipeline_key, o) AS pipeline_key, arg_min(failure_type, o) AS primary_failure_type,
               CASE WHEN arg_min(failure_type, o) IN ('job_crash', 'schema_drift') THEN 'high'
                    ELSE arg_min(severity, o) END AS severity, 'OPEN' AS status
        FROM (SELECT *, {'p': prio, 'r': rule_rank, 'd': detected_at, 'b': detected_by, 't': tie} AS o FROM signals)
        GROUP BY job_run_id""",
    "signal_table": """
        SELECT DISTINCT sha1('incident:' || job_run_id) AS incident_id, job_run_id, failure_type, detected_by, prio
        FROM signals""",
    "mapped": """
        SELECT *, CASE primary_failure_type WHEN 'job_crash' THEN 'retry_adjusted_config'
                 WHEN 'late_data' THEN 'retry_adjusted_config' WHEN 'null_spike' THEN 'quarantine_reprocess'
                 WHEN 'duplicate_explosion' THEN 'quarantine_reprocess'
                 WHEN 'schema_drift' THEN 'schema_evolution_ddl' ELSE 'diagnosis_only' END AS remediation_type,
               CASE primary_failure_type
                 WHEN 'job_crash' THEN '{"spark.sql.shuffle.partitions":"200","maxRecordsPerFile":"50000","max_retries":"2","timeout_seconds":"3600"}'
                 WHEN 'late_data' THEN '{"lookback_hours":"168","mode":"replay_window"}'
                 WHEN 'null_spike' THEN '{"strategy":"drop_null_keys","column":"email","key":"customer_id"}'
                 WHEN 'duplicate_explosion' THEN '{"strategy":"keep_latest_per_key","key":"order_id"}'
                 WHEN 'schema_drift' THEN '{"action":"generate_and_apply_additive"}'
                 ELSE '{"reason":"no safe automatic remediation for volume spikes"}' END AS parameters
        FROM incident_table""",
    "requests": """
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_id,
               sha1('incident:' || l_orderkey) AS incident_id,
               CASE l_linenumber % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'INVESTIGATING' WHEN 2 THEN 'AWAITING_APPROVAL'
                 ELSE 'RESOLVED' END AS to_status,
               TIMESTAMP '2024-01-31 12:00:00' + INTERVAL 12 HOUR + to_seconds(dayofyear(l_shipdate) * 3600 + l_partkey % 3600)
                 AS changed_at,
               'operator-' || (l_suppkey % 10) AS changed_by
        FROM lineitem""",
    "changes": """
        SELECT r.*, CASE WHEN i.incident_id IS NOT NULL THEN
                 coalesce(lag(r.to_status) OVER (PARTITION BY r.incident_id ORDER BY changed_at, request_id), 'OPEN')
               END AS from_status
        FROM requests r LEFT JOIN incident_table i USING (incident_id)""",
    "events_worked": """
        SELECT incident_id, CAST(NULL AS VARCHAR) AS from_status, 'OPEN' AS to_status, detected_at AS changed_at,
               0 AS late, '' AS rid
        FROM incident_table
        UNION ALL
        SELECT incident_id, from_status, to_status, changed_at, 1, sha1('event:' || incident_id || ':' || request_id)
        FROM changes WHERE from_status <> to_status""",
    "status_now": """
        SELECT incident_id, arg_max(to_status, {'c': changed_at, 'r': rid}) AS status, max(changed_at) AS changed_at
        FROM events_worked GROUP BY incident_id""",
    "proposals": """
        SELECT incident_id,
               CASE WHEN pipeline_key = 'reviews_enrichment' THEN 'diagnosis_only' ELSE remediation_type END
                 AS remediation_type,
               CASE WHEN pipeline_key = 'reviews_enrichment' THEN detected_at + INTERVAL 1 HOUR ELSE detected_at END
                 AS created_at
        FROM mapped""",
    "decision_rows": """
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS decision_id,
               sha1('incident:' || l_orderkey) AS incident_id,
               CASE WHEN l_linenumber % 3 = 0 THEN 'rejected' ELSE 'approved' END AS decision,
               'operator-' || (l_suppkey % 10) AS decided_by,
               TIMESTAMP '2024-02-01' + to_days(32) + to_seconds(dayofyear(l_shipdate) * 3600 + l_partkey % 3600)
                 AS decided_at
        FROM lineitem""",
    "decided_to": """
        SELECT d.*, p.remediation_type AS kind, s.status AS start,
               CASE WHEN decision = 'rejected' THEN 'INVESTIGATING'
                    WHEN p.remediation_type = 'diagnosis_only' THEN 'RESOLVED' END AS leads
        FROM decision_rows d LEFT JOIN proposals p USING (incident_id) LEFT JOIN status_now s USING (incident_id)""",
    "decided_from": """
        SELECT *, coalesce(last_value(leads IGNORE NULLS) OVER (PARTITION BY incident_id
                   ORDER BY decided_at, decision_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) AS before
        FROM decided_to""",
    "decided": """
        SELECT decision_id, incident_id, decision, decided_by, decided_at,
               CASE WHEN ok THEN kind END AS remediation_type, before AS from_status,
               CASE WHEN ok THEN coalesce(leads, before) END AS to_status,
               CASE WHEN start IS NULL THEN 'incident not found'
                    WHEN NOT ok THEN 'cannot approve from status ' || before END AS error
        FROM (SELECT *, start IS NOT NULL
                  AND (decision = 'rejected' OR before IN ('OPEN', 'INVESTIGATING', 'AWAITING_APPROVAL')) AS ok
              FROM decided_from)""",
    "events_all": """
        SELECT incident_id, from_status, to_status, changed_at FROM events_worked
        UNION ALL
        SELECT incident_id, from_status, to_status, decided_at FROM decided
        WHERE error IS NULL AND from_status <> to_status""",
    "order_truth": """
        SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS job_run_id, 'job_crash' AS failure_type FROM lineitem
        WHERE l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linestatus = 'O') OR l_linenumber = 7""",
    "prove_found": """
        SELECT run_id AS job_run_id, failure_type FROM class_of
        UNION SELECT 'prove-job_crash', 'job_crash' UNION SELECT 'prove-schema_drift', 'schema_drift'
        UNION SELECT 'prove-volume_anomaly', 'volume_anomaly' FROM raw_lines
              HAVING count(*) FILTER ((l_orderkey * 8 + l_linenumber) % 20 = 0) < 0.5 * count(*)""",
    "prove_card": """
        SELECT count(*) FILTER (e) AS expected, count(*) FILTER (d) AS detected,
               count(*) FILTER (e AND d) AS true_positives, count(*) FILTER (d AND NOT e) AS false_positives,
               count(*) FILTER (e AND NOT d) AS false_negatives
        FROM (SELECT f.job_run_id IS NOT NULL AS d, t.f IS NOT NULL AS e
              FROM prove_found f FULL OUTER JOIN (VALUES ('job_crash'), ('schema_drift'), ('duplicate_explosion'),
                ('null_spike'), ('volume_anomaly'), ('late_data')) t(f)
              ON f.job_run_id = 'prove-' || t.f AND f.failure_type = t.f)""",
    "customer_travel": """
        SELECT 'demo.silver.customers' AS table_name, count(*) AS current_count, count(*) FILTER (k % 7 <> 0) AS earlier_count,
               count(*) FILTER (k % 7 = 0) AS n_added, count(*) FILTER (k % 7 <> 0 AND k % 2 = 0) AS n_changed, 0 AS n_removed
        FROM (SELECT CAST(customer_id AS BIGINT) AS k FROM customers_silver)""",
    "table_evidence": """
        SELECT table_name, (SELECT 'customer_id=' || string_agg(customer_id, ',' ORDER BY customer_id) FROM (
                 SELECT customer_id FROM customers_silver WHERE CAST(customer_id AS BIGINT) % 2 = 0
                 ORDER BY customer_id LIMIT 5)) AS sampled,
               'current=' || current_count || ' earlier=' || earlier_count || ' added=' || n_added || ' changed=' || n_changed
                 || ' removed=' || n_removed AS compared
        FROM customer_travel""",
    "looked_at": """
        SELECT run_id, sampled, compared
        FROM (SELECT run_id, arg_min(table_name, CASE failure_type WHEN 'duplicate_explosion' THEN 2
                WHEN 'null_spike' THEN 3 ELSE 5 END) AS table_name FROM class_of GROUP BY 1) JOIN table_evidence USING (table_name)""",
    "commit_rows": """
        SELECT sha1('commit:' || p_partkey) AS sha, p_name AS message, p_brand AS author,
               TIMESTAMP '2024-01-01' + to_minutes(CAST(p_partkey * 7919 % 44640 AS INTEGER)) AS committed_at,
               CASE p_partkey % 4 WHEN 0 THEN 'src/demo' WHEN 1 THEN 'src/ops' WHEN 2 THEN 'src/detection'
                 ELSE 'docs' END || '/' || lower(p_type) || '.py,README.md' AS files
        FROM part""",
    "hinted": """
        SELECT *, row_number() OVER (PARTITION BY hint ORDER BY committed_at DESC, sha) AS rank
        FROM (SELECT *, 'src/demo' AS hint FROM commit_rows WHERE contains(files, 'src/demo')
              UNION ALL SELECT *, 'src/' FROM commit_rows WHERE contains(files, 'src/'))""",
    "doc_parts": """
        SELECT doc_id, 'doc_' || doc_id AS stem,
               CASE doc_id % 9 WHEN 0 THEN 'job_crash' WHEN 1 THEN 'schema_drift' WHEN 2 THEN 'duplicate_explosion'
                 WHEN 3 THEN 'null_spike' WHEN 4 THEN 'volume_anomaly' WHEN 5 THEN 'late_data' END AS failure_type,
               unnest(p) AS part, generate_subscripts(p, 1) - 1 AS i
        FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(10), chr(10) || '## '),
                       '^\\s+|\\s+$', '', 'g'), chr(10) || '## ') AS p FROM documents)""",
    "chunks": """
        SELECT stem || '-' || i || CASE WHEN p > 0 THEN '-' || p ELSE '' END AS chunk_id,
               'runbooks/' || stem || '.md' AS runbook_path, failure_type, 'Doc ' || doc_id AS title,
               substr(body, p * 900 + 1, 900) AS chunk_text
        FROM (SELECT *, unnest(range(0, (length(body) - 1) // 900 + 1)) AS p
              FROM (SELECT *, regexp_replace(CASE WHEN i = 0 THEN part ELSE '## ' || part END,
                           '^\\s+|\\s+$', '', 'g') AS body FROM doc_parts)
              WHERE body <> '')""",
    "chunk_slots": """
        SELECT chunk_id, idx, sum(sign) AS w FROM (
          SELECT chunk_id, ('0x' || substr(h, 1, 2))::INT AS idx, 1 - 2 * (('0x' || substr(h, 9, 2))::INT % 2) AS sign
          FROM (SELECT chunk_id, sha256(unnest(regexp_extract_all(lower(chunk_text), '[a-z0-9_]+'))) AS h FROM chunks))
        GROUP BY chunk_id, idx HAVING sum(sign) <> 0""",
    "chunk_vectors": """
        SELECT chunk_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS w FROM chunk_slots""",
    "asked": """
        SELECT DISTINCT f || '|' || pipeline_key AS query_id, f || ' ' || pipeline_key || ' incident investigation' AS q,
               f AS failure_type
        FROM (SELECT DISTINCT pipeline_key FROM runs),
             (VALUES ('job_crash'), ('schema_drift'), ('duplicate_explosion'), ('null_spike'), ('volume_anomaly'),
                     ('late_data')) c(f)""",
    "asked_incidents": """
        SELECT DISTINCT primary_failure_type || '|' || pipeline_key AS query_id,
               primary_failure_type || ' ' || pipeline_key || ' incident investigation' AS q,
               primary_failure_type AS failure_type
        FROM incident_table""",
}


def _hits(asked: str) -> str:
    """Top three chunks per question of ``asked``."""
    return f"""
        SELECT query_id, chunk_id, runbook_path, title, score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id
                   ORDER BY exact DESC, score DESC, chunk_id) AS rank
          FROM (
            SELECT a.query_id, c.chunk_id, c.runbook_path, c.title,
                   coalesce(c.failure_type = a.failure_type, false) AS exact, round(coalesce(s.score, 0.0), 9) AS score
            FROM {asked} a JOIN chunks c ON c.failure_type IS NULL OR c.failure_type = a.failure_type
            LEFT JOIN (
              SELECT q.query_id, v.chunk_id, sum(q.w * v.w) AS score FROM (
                SELECT query_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM (
                  SELECT query_id, ('0x' || substr(h, 1, 2))::INT AS idx,
                         sum(1 - 2 * (('0x' || substr(h, 9, 2))::INT % 2)) AS w
                  FROM (SELECT query_id, sha256(unnest(regexp_extract_all(lower(q), '[a-z0-9_]+'))) AS h FROM {asked})
                  GROUP BY 1, 2) WHERE w <> 0) q
              JOIN chunk_vectors v USING (idx) GROUP BY 1, 2) s
              ON s.query_id = a.query_id AND s.chunk_id = c.chunk_id))
        WHERE rank <= 3"""


PARTS["hits"] = _hits("asked")
PARTS["hits_incidents"] = _hits("asked_incidents")

PARTS["report"] = """
        SELECT m.incident_id, m.job_run_id, m.pipeline_key,
               'Investigation of ' || m.primary_failure_type || ' on pipeline `' || m.pipeline_key || '` (run `'
                 || m.job_run_id || '`).' AS summary,
               CASE m.primary_failure_type
                 WHEN 'null_spike' THEN 'Null rate exceeded threshold on a monitored column (DQ null check failed).'
                 WHEN 'duplicate_explosion' THEN 'Natural-key duplicate rate exceeded threshold after a join/merge.'
                 WHEN 'late_data' THEN 'Event lag exceeded the late-data watermark (pct_late / lag_minutes).'
                 WHEN 'volume_anomaly' THEN 'Row volume moved outside the cold-start/z-score envelope vs prior runs.'
                 WHEN 'schema_drift' THEN 'Schema drift detected vs prior snapshot (added=' ||
                      coalesce('[' || d.added || ']', 'None') || ', removed=' || coalesce('[' || d.removed || ']', 'None') || ').'
                 ELSE 'Task crashed/failed at runtime (' || coalesce(l.sig, 'see raw_task_logs') || ').' END AS root_cause,
               m.primary_failure_type AS root_cause_type,
               'Pipeline `' || m.pipeline_key || '` and downstream consumers of its silver/gold tables.' AS blast_radius,
               'primary_failure_type=' || m.primary_failure_type || '|signals=[' || s.classes || ']|dq_failures='
                 || coalesce(q.n, 0) || '|task_logs=' || coalesce(l.n, 0) || '|schema_diff='
                 || coalesce(d.txt, 'insufficient schema snapshots')
                 || coalesce('|sampled_bad_records=' || e.sampled, '') || coalesce('|time_travel=' || e.compared, '') AS evidence,
               substr(c.sha, 1, 12) AS suspected_commit_sha,
               m.remediation_type || ': ' || m.parameters AS remediation_proposal,
               h.runbook_path AS cited_runbook,
               CASE WHEN e.run_id IS NULL THEN 6 ELSE 8 END AS tool_trace_len
        FROM mapped m
        LEFT JOIN looked_at e ON e.run_id = m.job_run_id
        JOIN (SELECT incident_id, string_agg(failure_type, ', ' ORDER BY failure_type) AS classes
              FROM (SELECT DISTINCT incident_id, failure_type FROM signal_table) GROUP BY 1) s USING (incident_id)
        LEFT JOIN (SELECT run_id, count(*) AS n FROM dq_facts WHERE NOT passed GROUP BY 1) q ON q.run_id = m.job_run_id
        LEFT JOIN (SELECT run_id, count(*) AS n,
                          arg_max(error_signature, {'c': collected_at, 't': task_run_id}) AS sig
                   FROM task_logs GROUP BY 1) l ON l.run_id = m.job_run_id
        LEFT JOIN (SELECT pipeline_key, added, removed, 'added=' || added || ' removed=' || removed || ' retyped='
                     || CASE WHEN type_changes = '' THEN '' ELSE 'value' END AS txt FROM diffs) d
               ON d.pipeline_key = m.pipeline_key
        LEFT JOIN (SELECT * FROM hinted WHERE rank = 1) c
               ON c.hint = CASE WHEN m.pipeline_key IN ('orders_ingest', 'customers_scd2', 'products_catalog',
                     'events_clickstream', 'reviews_enrichment') THEN 'src/demo' ELSE 'src/' END
        LEFT JOIN (SELECT * FROM hits_incidents WHERE rank = 1) h
               ON h.query_id = m.primary_failure_type || '|' || m.pipeline_key"""


def _uses(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))
    return [name for name in PARTS if name in words]


def render(sql: str) -> str:
    """Prefix a statement with the shared parts it uses, directly or through other parts."""
    needed: set[str] = set()
    todo = _uses(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [n for n in _uses(PARTS[name]) if n != name]
    if not needed:
        return sql.strip()
    ordered: list[str] = []

    def place(name: str) -> None:
        if name in ordered:
            return
        for other in _uses(PARTS[name]):
            if other != name:
                place(other)
        ordered.append(name)

    for name in PARTS:
        if name in needed:
            place(name)
    body = ",\n".join(f"{n} AS ({PARTS[n]})" for n in ordered)
    return f"WITH {body}\n{sql.strip()}"

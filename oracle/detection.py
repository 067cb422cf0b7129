"""Logs, telemetry, detection and incidents."""

_DECISION = """
        SELECT run_id AS job_run_id, pipeline_key, '{failure}' AS failure_type, 'workflow' AS detected_by,
               'medium' AS severity, ended_at AS detected_at, task_name, {shown}, 'zscore' AS mode,
               round({mean}, 6) AS baseline, round({z}, 6) AS score, {reason} AS reason
        FROM scored WHERE {z} >= 3"""

SQL = {
    "task_log_explode": "SELECT * FROM task_logs",
    "stream_task_logs": "SELECT * FROM task_logs",
    "stream_signals": "SELECT * FROM incident_table",
    "error_signature": "SELECT error_signature, count(*) AS n FROM task_logs GROUP BY 1",
    "parsed_error_signatures": """
        SELECT pipeline_key,
               nullif(regexp_extract(raw_output, '([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception)):', 1), '') AS error_class,
               nullif(regexp_extract(raw_output, '[A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception): ([^\n]*)', 1), '')
                 AS error_message,
               TRY_CAST(nullif(regexp_extract(raw_output, 'stage ([0-9]+)', 1), '') AS INTEGER) AS failing_stage,
               count(*) AS n
        FROM task_logs GROUP BY ALL""",
    "task_log_excerpts": """
        SELECT run_id, task_run_id, task_key, error_signature, substr(raw_output, 1, 1500) AS raw_output_excerpt,
               collected_at
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY collected_at DESC, task_run_id) AS rn
              FROM task_logs) WHERE rn <= 20""",
    "task_log_outputs": """
        SELECT run_id, task_run_id,
               CASE WHEN error_signature = 'unknown_failure' AND contains(raw2, 'Error') THEN 'Error'
                    ELSE error_signature END AS error_signature, raw2 AS raw_output
        FROM (SELECT *, CASE WHEN CAST(task_run_id AS BIGINT) % 5 = 0
                THEN raw_output || chr(10) || 'get-output failed: 404 not found: Error'
                ELSE raw_output || chr(10) || 'exit code ' || (CAST(task_run_id AS BIGINT) % 3)
                     || CASE WHEN CAST(task_run_id AS BIGINT) % 2 = 0 THEN chr(10) || 'done' ELSE '' END END AS raw2
              FROM task_logs)""",
    "current_vs_history": "SELECT run_id, pipeline_key, task_name, rows_out, ended_at, is_current FROM flagged",
    "run_history": """
        SELECT run_id, pipeline_key, task_name, status, rows_in, rows_out, duration_ms, ended_at, error_class
        FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_key ORDER BY ended_at DESC, run_id DESC) AS rn
              FROM runs) WHERE rn <= 5""",
    "schema_diff_latest": """
        SELECT pipeline_key, current_run_id, previous_run_id, added, removed, type_changes,
               CAST(NULL AS VARCHAR) AS reason
        FROM diffs""",
    "slow_runs": """
        SELECT r.run_id, r.pipeline_key, r.task_name, r.day AS run_date, r.duration_ms,
               round(quantile_cont(CAST(h.duration_ms AS DOUBLE), 0.5), 6) AS median_ms
        FROM runs r JOIN runs h ON h.pipeline_key = r.pipeline_key AND h.day BETWEEN r.day - 7 AND r.day - 1
        GROUP BY ALL HAVING r.duration_ms > 2 * quantile_cont(CAST(h.duration_ms AS DOUBLE), 0.5)""",
    "fact_job_run": """
        SELECT run_id, pipeline_key, task_name, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, status,
               status = 'FAILED' AS is_failed, duration_ms, rows_in, rows_out, error_class
        FROM runs""",
    "dim_date": """
        SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS date,
               CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day,
               CAST(isodow(d) - 1 AS INTEGER) AS weekday
        FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS d FROM runs)""",
    "dim_pipeline": """
        SELECT pipeline_key, min(started_at) AS first_seen, max(ended_at) AS last_seen FROM runs GROUP BY 1""",
    "snapshot_compare": """
        SELECT 'events' AS table_name, arg_max(n, d) AS current_count,
               arg_max(n, d) FILTER (d <= TIMESTAMP '2024-01-30') AS earlier_count,
               max(d) FILTER (d <= TIMESTAMP '2024-01-30') AS earlier_snapshot_ts
        FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, count(*) AS n FROM events GROUP BY 1)
        WHERE d <= TIMESTAMP '2024-01-31'""",
    "detect_job_crash": "SELECT * EXCLUDE (rule_rank) FROM crash_signals",
    "detect_status_failure": """
        SELECT run_id AS job_run_id, pipeline_key, 'job_crash' AS failure_type, 'workflow' AS detected_by,
               'high' AS severity, ended_at AS detected_at, task_name, error_class, error_message,
               '' AS stacktrace_excerpt
        FROM flagged WHERE is_current AND status = 'FAILED'""",
    "detect_dq_failure": """
        SELECT run_id AS job_run_id, pipeline_key, failure_type, 'workflow' AS detected_by, 'medium' AS severity,
               checked_at AS detected_at, check_name, table_name, metric_name,
               round(observed_value, 6) AS observed_value, threshold_value, comparator
        FROM class_of""",
    "detect_volume": _DECISION.format(
        failure="volume_anomaly",
        shown="rows_out",
        mean="v_mean",
        z="v_z",
        reason="printf('volume |z|=%.2f (mu=%.1f, sigma=%.1f)', v_z, v_mean, coalesce(nullif(v_sigma, 0), 1e-9))",
    ),
    "detect_volume_cold": """
        SELECT run_id AS job_run_id, pipeline_key, 'volume_anomaly' AS failure_type, 'workflow' AS detected_by,
               'medium' AS severity, ended_at AS detected_at, task_name, rows_out, 'cold_start' AS mode,
               CAST(last AS DOUBLE) AS baseline, round(CASE WHEN last > 0 THEN rows_out / last END, 6) AS score,
               'volume ratio vs previous=' || coalesce(CAST(round(CASE WHEN last > 0 THEN rows_out / last END, 6)
                 AS VARCHAR), 'None') AS reason
        FROM flagged JOIN (
          SELECT pipeline_key, CAST(arg_max(rows_out, ended_at) AS DOUBLE) AS last, count(*) AS n FROM flagged
          WHERE NOT is_current AND ended_at >= TIMESTAMP '2024-01-28' GROUP BY 1) USING (pipeline_key)
        WHERE is_current AND n < 7
          AND CASE WHEN last <= 0 THEN rows_out > 0 ELSE rows_out / last < 0.5 OR rows_out / last > 2 END""",
    "detect_null_spike": _DECISION.format(
        failure="null_spike",
        shown="round(null_rate, 6) AS null_rate",
        mean="r_mean",
        z="r_z",
        reason="printf('null_rate z=%.2f (mu=%.3f, sigma=%.3f)', r_z, r_mean, coalesce(nullif(r_sigma, 0), 1e-9))",
    ),
    "detect_schema_drift": """
        SELECT run_id AS job_run_id, pipeline_key, 'schema_drift' AS failure_type, 'workflow' AS detected_by,
               'high' AS severity, ended_at AS detected_at, 'event_type_v2' AS added_columns,
               'event_type' AS removed_columns, 'value:double>string' AS type_changes
        FROM drift""",
    "duration_decision": """
        SELECT run_id, pipeline_key, task_name, d_z >= 3 AS is_anomaly, 'zscore' AS mode,
               CAST(duration_ms AS DOUBLE) AS observed, round(d_mean, 6) AS baseline, round(d_z, 6) AS score,
               printf('duration z=%.2f (mu=%.1f, sigma=%.1f)', d_z, d_mean, coalesce(nullif(d_sigma, 0), 1e-9)) AS reason
        FROM scored""",
    "volume_iqr": """
        SELECT run_id, pipeline_key, rows_out, round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence,
               round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence,
               rows_out < q1 - 1.5 * (q3 - q1) OR rows_out > q3 + 1.5 * (q3 - q1) AS is_anomaly
        FROM flagged JOIN (SELECT pipeline_key, quantile_cont(CAST(rows_out AS DOUBLE), 0.25) AS q1,
                                  quantile_cont(CAST(rows_out AS DOUBLE), 0.75) AS q3
                           FROM flagged WHERE NOT is_current GROUP BY 1) USING (pipeline_key)
        WHERE is_current""",
    "running_baseline": """
        SELECT run_id, task_name, rows_out, n, round(m, 4) AS mean, round(s, 4) AS sigma,
               CASE WHEN n < 7 THEN 'cold_start' ELSE 'zscore' END AS mode,
               CASE WHEN n = 0 THEN false
                    WHEN n < 7 AND l <= 0 THEN rows_out > 0
                    WHEN n < 7 THEN rows_out / l < 0.5 OR rows_out / l > 2
                    ELSE abs(rows_out - m) / coalesce(nullif(s, 0), 1e-9) >= 3 END AS is_anomaly
        FROM (SELECT *, count(*) OVER w AS n, avg(CAST(rows_out AS DOUBLE)) OVER w AS m,
                     stddev_pop(CAST(rows_out AS DOUBLE)) OVER w AS s,
                     CAST(last_value(rows_out) OVER w AS DOUBLE) AS l
              FROM runs WINDOW w AS (PARTITION BY pipeline_key, task_name ORDER BY ended_at, run_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "all_signals": """
        SELECT job_run_id, pipeline_key, failure_type, detected_by, severity, detected_at, rule_rank FROM signals""",
    "signal_evidence": """
        SELECT job_run_id, 1 AS rule_rank, task_key AS subject, error_signature AS detail, raw_output_excerpt AS shown
        FROM crash_signals
        UNION ALL SELECT run_id, 2, task_name, error_class, error_message FROM flagged WHERE is_current AND status = 'FAILED'
        UNION ALL SELECT run_id, 3, check_name, table_name, metric_name FROM class_of
        UNION ALL SELECT run_id, 4, task_name, 'zscore', CAST(rows_out AS VARCHAR) FROM scored WHERE v_z >= 3
        UNION ALL SELECT run_id, 5, task_name, 'zscore', NULL FROM scored WHERE r_z >= 3
        UNION ALL SELECT run_id, 6, 'event_type_v2', 'event_type', 'value' FROM drift""",
    "telemetry_rows": """
        SELECT name || '-run' AS run_id, name AS pipeline_key, 'load' AS task_name, 'SUCCESS' AS status,
               CAST(n_in AS BIGINT) AS rows_in, CAST(n_out AS BIGINT) AS rows_out, round(nulls / n_out, 6) AS null_rate, columns
        FROM (
          SELECT 'customers' AS name, (SELECT count(*) + count(*) FILTER (c_custkey % 3 = 0) FROM customer) AS n_in,
                 (SELECT count(*) FROM customers_silver) AS n_out, 0 AS nulls,
                 'customer_id,email,full_name,country,created_at,updated_at' AS columns
          UNION ALL SELECT 'products', (SELECT count(*) + count(*) FILTER (p_partkey % 3 = 0) FROM part),
                 (SELECT count(*) FROM products_silver), 0, 'product_id,sku,name,category,price_usd,is_active,updated_at'
          UNION ALL SELECT 'events', (SELECT count(*) + count(*) FILTER (event_id % 3 = 0) FROM events),
                 (SELECT count(*) FROM events_silver), (SELECT count(*) FILTER (product_id IS NULL) FROM events_silver),
                 'event_id,customer_id,product_id,event_type,event_ts,process_ts,lag_minutes'
          UNION ALL SELECT 'reviews', (SELECT count(*) + count(*) FILTER (length(text) % 3 = 0) FROM conversations),
                 (SELECT count(*) FROM reviews_silver), 0, 'review_id,customer_id,product_id,rating,review_text,review_ts')""",
    "dim_failure_type": """
        SELECT failure_type, count(*) AS n_signals, min(detected_at) AS first_seen, max(detected_at) AS last_seen,
               min(prio) AS priority,
               CASE WHEN failure_type IN ('job_crash', 'late_data') THEN 'retry_adjusted_config'
                    WHEN failure_type IN ('null_spike', 'duplicate_explosion') THEN 'quarantine_reprocess'
                    WHEN failure_type = 'schema_drift' THEN 'schema_evolution_ddl' ELSE 'diagnosis_only' END AS remediation_type
        FROM signals GROUP BY 1""",
    "stream_telemetry": """
        WITH arrived AS (
          SELECT ts, least((day(ts) - 1) // 8 + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END, 3) AS batch FROM events),
        reached AS (
          SELECT batch, newest, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                   - INTERVAL 2880 MINUTE AS watermark
          FROM (SELECT batch, max(ts) AS newest FROM arrived GROUP BY 1))
        SELECT 'events_clickstream' AS pipeline_key, CAST(batch AS BIGINT) AS batch, count(*) AS rows_in,
               count(*) FILTER (NOT coalesce(ts < watermark, false)) AS rows_out,
               count(*) FILTER (coalesce(ts < watermark, false)) AS late_rows, any_value(newest) AS newest,
               any_value(watermark) AS watermark
        FROM arrived JOIN reached USING (batch) GROUP BY batch""",
    "incidents": "SELECT * FROM incident_table",
    "incident_dedup": """
        SELECT incident_id, job_run_id, pipeline_key, primary_failure_type, severity FROM incident_table
        WHERE job_run_id NOT IN (SELECT job_run_id FROM crash_signals)""",
    "incident_upsert": """
        SELECT coalesce(i.incident_id, sha1('incident:' || o_orderkey)) AS incident_id,
               coalesce(i.job_run_id, CAST(o_orderkey AS VARCHAR)) AS job_run_id,
               CASE WHEN o_orderkey IS NULL THEN i.pipeline_key ELSE 'events_clickstream' END AS pipeline_key,
               CASE WHEN o_orderkey IS NULL THEN i.primary_failure_type ELSE 'late_data' END AS primary_failure_type,
               coalesce(i.severity, 'medium') AS severity,
               CASE WHEN o_orderkey IS NULL THEN s.status ELSE 'OPEN' END AS status
        FROM incident_table i FULL OUTER JOIN orders ON CAST(o_orderkey AS VARCHAR) = i.job_run_id
        LEFT JOIN status_now s ON s.incident_id = i.incident_id""",
    "incident_signals_join": "SELECT incident_id, job_run_id, failure_type, detected_by FROM signal_table",
    "incident_with_signals": """
        SELECT i.incident_id, i.pipeline_key,
               string_agg(s.failure_type, ',' ORDER BY prio, s.failure_type, s.detected_by) AS classes,
               string_agg(s.detected_by, ',' ORDER BY prio, s.failure_type, s.detected_by) AS detectors
        FROM incident_table i JOIN signal_table s USING (incident_id) GROUP BY 1, 2""",
    "detected_incidents": "SELECT DISTINCT incident_id FROM signal_table",
    "detection_summary": """
        SELECT (SELECT count(*) FROM signals) AS signals_evaluated,
               (SELECT count(*) FROM (SELECT DISTINCT job_run_id, failure_type, detected_by FROM signals)) AS signals_written,
               count(*) AS incidents_seen,
               count(*) FILTER (job_run_id NOT IN (SELECT job_run_id FROM crash_signals)) AS incidents_created
        FROM incident_table""",
    "schema_ddl": """
        SELECT f.pipeline_key AS table_name,
               CASE WHEN any_value(f.bad) THEN
                 'ALTER TABLE ' || f.pipeline_key || ' ADD COLUMN event_type STRING COMMENT ''restored alias for event_type_v2'''
               ELSE '-- No additive DDL required for ' || f.pipeline_key END AS ddl_text
        FROM (SELECT pipeline_key, run_id, contains(snap, '_v2') AS bad,
                     row_number() OVER (PARTITION BY pipeline_key ORDER BY contains(snap, '_v2') DESC) AS rn
              FROM flagged WHERE is_current) f WHERE rn = 1 GROUP BY 1""",
}

SQL["stream_running_baseline"] = SQL["running_baseline"]

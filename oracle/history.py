"""Status changes, approvals, scoring, analytics and reports."""

SQL = {
    "list_incidents": """
        SELECT i.incident_id, i.job_run_id, i.pipeline_key, i.primary_failure_type, i.severity, s.status,
               CAST(NULL AS VARCHAR) AS rca_report_path, CAST(NULL AS VARCHAR) AS linked_commit_sha, i.detected_at
        FROM incident_table i JOIN status_now s USING (incident_id) WHERE s.status = 'OPEN'
        ORDER BY i.detected_at DESC, i.incident_id LIMIT 50""",
    "unclaimed_incidents": """
        SELECT i.incident_id, i.job_run_id, i.detected_at
        FROM incident_table i JOIN status_now s USING (incident_id) WHERE s.status = 'OPEN'""",
    "apply_status_changes": """
        SELECT incident_id, from_status, to_status, changed_at, changed_by,
               CASE WHEN from_status IS NULL THEN 'incident not found' WHEN from_status = to_status THEN 'noop'
                    ELSE 'applied' END AS outcome
        FROM changes""",
    "pipeline_status_chain": """
        SELECT *, row_number() OVER w - 1 AS n_before,
               last_value(to_status IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS status_before
        FROM (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_id,
                     'flow-' || (l_partkey % 6 % 4) AS flow, CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus END AS to_status,
                     l_orderkey % 3600 AS second FROM lineitem)
        WINDOW w AS (PARTITION BY flow ORDER BY second, request_id)""",
    "current_status": "SELECT incident_id, status, changed_at FROM status_now",
    "latest_proposal": "SELECT * FROM proposals",
    "apply_approvals": "SELECT * FROM decided",
    "incident_timeline": """
        SELECT incident_id, 'signal' AS kind, arg_min(detected_at, o) AS at, failure_type AS detail
        FROM (SELECT *, sha1('incident:' || job_run_id) AS incident_id,
                     {'p': prio, 'r': rule_rank, 'd': detected_at, 't': tie} AS o FROM signals)
        GROUP BY incident_id, failure_type, detected_by
        UNION ALL
        SELECT incident_id, 'status', changed_at, coalesce(from_status, '') || '->' || to_status FROM events_all
        UNION ALL
        SELECT incident_id, 'action', TIMESTAMP '2024-01-31' + to_seconds(row_number() OVER
                 (PARTITION BY incident_id ORDER BY s.i) - 1), s.tool
        FROM report, (VALUES (0, 'update_incident_status', false), (1, 'query_run_history', false),
               (2, 'get_dq_failures', false), (3, 'read_task_logs', false), (4, 'diff_schema', false),
               (5, 'correlate_github_commits', false), (6, 'sample_bad_records', true),
               (7, 'time_travel_compare', true), (8, 'search_runbooks', false), (9, 'save_rca_report', false),
               (10, 'propose_remediation', false)) s(i, tool, extra)
        WHERE NOT s.extra OR contains(evidence, 'time_travel=')
        UNION ALL
        SELECT incident_id, 'approval', decided_at, decision FROM decided WHERE error IS NULL""",
    "detection_scorecard": """
        SELECT count(*) FILTER (e) AS expected, count(*) FILTER (d) AS detected,
               count(*) FILTER (e AND d) AS true_positives, count(*) FILTER (d AND NOT e) AS false_positives,
               count(*) FILTER (e AND NOT d) AS false_negatives,
               round(CAST(count(*) FILTER (e AND d) AS DOUBLE) / count(*) FILTER (d), 6) AS precision,
               round(CAST(count(*) FILTER (e AND d) AS DOUBLE) / count(*) FILTER (e), 6) AS recall
        FROM (SELECT t.job_run_id IS NOT NULL AS e, i.job_run_id IS NOT NULL AS d
              FROM order_truth t FULL OUTER JOIN incident_table i
                ON t.job_run_id = i.job_run_id AND t.failure_type = i.primary_failure_type)""",
    "prove_matches": """
        SELECT 'prove-' || f AS job_run_id, f AS expected, CASE WHEN found THEN f END AS primary_failure_type,
               CASE WHEN found THEN 'OPEN' END AS status, found AS ok
        FROM (SELECT f, CASE f WHEN 'job_crash' THEN true WHEN 'schema_drift' THEN true
                WHEN 'volume_anomaly' THEN (SELECT count(*) FILTER ((l_orderkey * 8 + l_linenumber) % 20 = 0)
                                                   < 0.5 * count(*) FROM raw_lines)
                ELSE EXISTS (SELECT 1 FROM class_of c WHERE c.run_id = 'prove-' || f AND c.failure_type = f) END AS found
              FROM (VALUES ('job_crash'), ('schema_drift'), ('duplicate_explosion'), ('null_spike'),
                           ('volume_anomaly'), ('late_data')) v(f))""",
    "prove_scorecard": """
        SELECT s AS scored, prove_card.*, CAST(true_positives AS DOUBLE) / detected AS precision,
               CAST(true_positives AS DOUBLE) / expected AS recall
        FROM prove_card, (VALUES ('primary'), ('signals')) v(s)""",
    "rca_grades": """
        SELECT r.incident_id, r.job_run_id, CASE WHEN t.failure_type = root_cause_type THEN 2 ELSE 0 END AS score,
               'auto' AS grader,
               CASE WHEN t.failure_type = root_cause_type THEN 'type match + evidence'
                    WHEN t.failure_type IS NOT NULL THEN 'expected ' || t.failure_type || ', got ' || root_cause_type
                    ELSE 'missing expected failure type' END AS notes
        FROM report r LEFT JOIN order_truth t ON t.job_run_id = r.job_run_id""",
    "grade_summary": """
        SELECT count(*) AS n, round(avg(score), 6) AS mean, count(*) FILTER (score = 0) AS zeros,
               count(*) FILTER (score = 1) AS ones, count(*) FILTER (score = 2) AS twos,
               avg(score) >= 1.6 AND count(*) FILTER (score = 0) <= 1 AND count(*) >= 18 AS exit_criteria_met
        FROM (SELECT CASE WHEN t.failure_type = i.primary_failure_type THEN 2 ELSE 0 END AS score
              FROM incident_table i LEFT JOIN order_truth t USING (job_run_id)
              UNION ALL SELECT quality * 2 - quality * toxic FROM labels)""",
    "evaluation": """
        SELECT failure_type, repeat, count(*) AS n, 0 AS ungraded, round(avg(CASE WHEN k % 10 = 0 THEN 0.0 ELSE 2.0 END), 6) AS mean,
               count(*) FILTER (k % 10 = 0) AS zeros
        FROM (SELECT o_orderkey AS k, o_orderkey // 6 % 3 AS repeat,
                     ['job_crash', 'schema_drift', 'duplicate_explosion', 'null_spike', 'volume_anomaly', 'late_data']
                       [o_orderkey % 6 + 1] AS failure_type FROM orders)
        GROUP BY 1, 2""",
    "agent_accuracy": """
        SELECT primary_failure_type, count(*) AS n, round(avg(score), 6) AS mean_score,
               round(avg(CASE WHEN score = 2 THEN 1.0 ELSE 0.0 END), 6) AS full_marks_rate
        FROM (SELECT primary_failure_type, CASE WHEN t.failure_type = i.primary_failure_type THEN 2 ELSE 0 END AS score
              FROM incident_table i LEFT JOIN order_truth t USING (job_run_id))
        GROUP BY 1""",
    "correlate_commits": """
        SELECT pipeline_key, substr(sha, 1, 12) AS sha, message, author, committed_at, files, rank
        FROM hinted, (SELECT DISTINCT pipeline_key FROM runs) WHERE hint = 'src/demo' AND rank <= 5""",
    "commits_since_success": """
        SELECT p.pipeline_key, substr(sha, 1, 12) AS sha, committed_at, rank
        FROM hinted, (SELECT pipeline_key, max(ended_at) FILTER (status = 'SUCCESS') AS good
                      FROM runs GROUP BY 1) p
        WHERE hint = 'src/demo' AND rank <= 5 AND (good IS NULL OR committed_at > good)""",
    "rca_report": "SELECT * FROM report",
    "rca_markdown": """
        SELECT incident_id, array_to_string([
                 '# RCA — ' || incident_id, '', '**Summary:** ' || summary, '', '**Root cause:** ' || root_cause, '',
                 '**Failure type:** `' || root_cause_type || '`', '', '**Blast radius:** ' || blast_radius, '',
                 '## Evidence', '- ' || replace(evidence, '|', chr(10) || '- '), '',
                 '**Suspected commit:** ' || coalesce(suspected_commit_sha, 'n/a'), '',
                 '**Remediation proposal:** ' || remediation_proposal, '',
                 '**Cited runbook:** ' || coalesce(cited_runbook, ''), ''], chr(10)) AS markdown
        FROM report""",
    "remediation_plan": """
        SELECT incident_id, primary_failure_type, remediation_type, parameters, detected_at AS proposed_at
        FROM mapped""",
    "mttr_minutes": """
        SELECT round(avg(epoch(date_trunc('second', r)) - epoch(date_trunc('second', o))) / 60.0, 2) AS mttr_minutes,
               count(*) AS resolved_n
        FROM (SELECT incident_id, min(changed_at) FILTER (to_status = 'OPEN' OR from_status IS NULL) AS o,
                     min(changed_at) FILTER (to_status = 'RESOLVED') AS r
              FROM events_all GROUP BY 1)
        WHERE o IS NOT NULL AND r IS NOT NULL""",
    "incidents_by_status": "SELECT status, count(*) AS n FROM status_now GROUP BY 1",
    "incidents_by_failure": "SELECT primary_failure_type, count(*) AS n FROM incident_table GROUP BY 1",
    "approval_counts": """
        SELECT decision, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate
        FROM decided WHERE error IS NULL GROUP BY 1""",
    "approved_counts": """
        SELECT incident_id, count(*) AS n_approved FROM decided WHERE error IS NULL AND decision = 'approved' GROUP BY 1""",
    "signals_like": """
        SELECT job_run_id, failure_type, detected_by FROM signals
        WHERE job_run_id LIKE 'prove-%' AND failure_type IN ('null_spike', 'duplicate_explosion', 'late_data')""",
    "top_tools": """
        SELECT tool AS tool_name, count(*) AS n
        FROM (SELECT DISTINCT incident_id FROM incident_table),
             (VALUES ('update_incident_status'), ('query_run_history'), ('get_dq_failures'), ('read_task_logs'),
                     ('diff_schema'), ('correlate_github_commits'), ('search_runbooks'), ('save_rca_report'),
                     ('propose_remediation')) s(tool)
        GROUP BY 1
        UNION ALL
        SELECT tool, count(*) FROM report, (VALUES ('sample_bad_records'), ('time_travel_compare')) s(tool)
        WHERE contains(evidence, 'time_travel=') GROUP BY 1""",
    "mirror_merge": """
        SELECT incident_id, primary_failure_type, s.status, s.changed_at
        FROM incident_table i JOIN status_now s USING (incident_id)""",
    "mirror_as_of": """
        SELECT TIMESTAMP '2024-01-16' AS as_of, 'OPEN' AS status, count(*) AS n FROM incident_table
        WHERE detected_at < TIMESTAMP '2024-01-16' HAVING count(*) > 0
        UNION ALL SELECT TIMESTAMP '2024-02-01', status, count(*) FROM status_now GROUP BY 2""",
    "mirror_compare": """
        SELECT 'incidents' AS table_name, count(*) AS current_count, count(*) FILTER (early) AS earlier_count,
               count(*) FILTER (NOT early) AS n_added, count(*) FILTER (early AND moved) AS n_changed, 0 AS n_removed
        FROM (SELECT i.detected_at < TIMESTAMP '2024-01-16' AS early, s.changed_at > i.detected_at AS moved
              FROM incident_table i JOIN status_now s USING (incident_id))""",
    "time_travel_customers": "SELECT * FROM customer_travel",
    "claimed_incidents": """
        SELECT incident_id, CASE WHEN rn <= 100 THEN 'agent-1' ELSE 'agent-2' END AS claimed_by,
               TIMESTAMP '2024-01-30' AS agent_started_at
        FROM (SELECT incident_id, row_number() OVER (ORDER BY i.detected_at, incident_id) AS rn
              FROM incident_table i JOIN status_now s USING (incident_id) WHERE s.status = 'OPEN') WHERE rn <= 200""",
    "mirror_sync": """
        SELECT source || '_mirror' AS mirror, source, true AS ok, CAST(n AS BIGINT) AS row_count, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT 'incidents' AS source, (SELECT count(*) FROM incident_table) AS n
              UNION ALL SELECT 'incident_signals', (SELECT count(*) FROM signal_table)
              UNION ALL SELECT 'incident_status_events', (SELECT count(*) FROM events_all)
              UNION ALL SELECT 'approvals', (SELECT count(*) FROM decided WHERE error IS NULL)
              UNION ALL SELECT 'agent_actions', (SELECT sum(9 + CASE WHEN contains(evidence, 'time_travel=') THEN 2 ELSE 0 END) FROM report)
              UNION ALL SELECT 'audit_log', (SELECT count(*) FROM incident_table)
                + (SELECT count(*) + count(*) FILTER (pipeline_key = 'reviews_enrichment') FROM mapped))""",
    "incident_trend": """
        SELECT CAST(date_trunc('day', detected_at) AS TIMESTAMP) AS period, primary_failure_type, count(*) AS n
        FROM incident_table GROUP BY 1, 2""",
}

import json
import random
from datetime import timedelta

import pytest
from helpers import NOW, as_of, dq, duration_hit, log, null_hit, run, volume_hit
from pyspark.sql import functions as F

from runwarden import schemas
from runwarden.functions import decisions
from runwarden.operators import incidents, rules, scoring
from runwarden.operators.telemetry import current_vs_history


def scored(spark, *rows, **kw):
    return rules.scored_runs(run(spark, *rows), as_of(), 48, **kw)


def test_volume_collapse_against_short_history(spark):
    rows = [{"run_id": f"h{i}", "ago": 10 - i, "rows_out": v} for i, v in enumerate((100, 110, 105))]
    got = rules.detect_volume(scored(spark, *rows, {"run_id": "now", "rows_out": 5})).collect()
    assert [(r.job_run_id, r.failure_type, r.mode, r.baseline) for r in got] == [
        ("now", "volume_anomaly", "cold_start", 105.0)
    ]


@pytest.mark.parametrize("rate,hit", [(0.45, True), (0.05, False), (0.20, False)])
def test_null_rate_with_short_history(spark, rate, hit):
    rows = [
        {"run_id": f"h{i}", "ago": 9 - i, "metadata_json": json.dumps({"null_rate": 0.01})} for i in range(2)
    ] + [{"run_id": "now", "metadata_json": json.dumps({"null_rate": rate})}]
    assert (rules.detect_null_spike(scored(spark, *rows)).count() == 1) is hit


def test_malformed_metadata_and_missing_rate_are_skipped(spark):
    rows = [{"run_id": "a", "metadata_json": "{bad"}, {"run_id": "b", "task_name": "x", "metadata_json": "{}"}]
    assert rules.detect_null_spike(scored(spark, *rows)).count() == 0


def test_schema_drift_added_removed_retyped_and_both_baselines(spark):
    rows = [
        {"run_id": "h0", "ago": 9, "schema_snapshot_json": '{"a":"int"}'},
        {"run_id": "h1", "ago": 8, "schema_snapshot_json": '{"a":"int","b":"int"}'},
        {"run_id": "h2", "ago": 7, "schema_snapshot_json": "{broken"},
        {"run_id": "now", "schema_snapshot_json": '{"a":"string","b":"int"}'},
    ]
    oldest = rules.detect_schema_drift(scored(spark, *rows)).collect()[0]
    assert oldest.added_columns == ["b"] and oldest.removed_columns == []
    assert [(c["column"], c["from"], c["to"]) for c in oldest.type_changes] == [("a", "int", "string")]
    previous = rules.detect_schema_drift(scored(spark, *rows, snapshot_baseline="previous")).collect()[0]
    assert previous.added_columns == [] and len(previous.type_changes) == 1


def test_no_drift_without_previous_or_with_empty_previous(spark):
    assert rules.detect_schema_drift(scored(spark, {"schema_snapshot_json": '{"a":"int"}'})).count() == 0
    rows = [{"run_id": "h", "ago": 5, "schema_snapshot_json": "[1]"}, {"run_id": "n", "schema_snapshot_json": '{"a":"int"}'}]
    assert rules.detect_schema_drift(scored(spark, *rows)).count() == 0


def test_crash_rule(spark):
    got = rules.detect_job_crash(
        log(
            spark,
            {"run_id": "oom", "result_state": "FAILED", "error_signature": "Error", "raw_output": "java OutOfMemoryError: heap"},
            {"run_id": "plain", "result_state": "FAILED", "raw_output": "ValueError"},
            {"run_id": "timed", "result_state": "TIMEDOUT"},
            {"run_id": "internal", "lifecycle_state": "INTERNAL_ERROR"},
            {"run_id": "fine", "result_state": "SUCCESS", "raw_output": "ran out of memory but recovered"},
            {"run_id": "good", "result_state": "SUCCESS", "raw_output": "ok"},
        )
    ).collect()
    assert {r.job_run_id: r.severity for r in got} == {
        "oom": "high", "plain": "medium", "timed": "high", "internal": "medium", "fine": "high",
    }


def test_check_classes_in_fragment_order(spark):
    names = {
        ("orders_duplicate_rate", "duplicate_rate"): "duplicate_explosion",
        ("events_lag_under_48h", "pct_late"): "late_data",
        ("row_count_ok", "n"): "volume_anomaly",
        ("schema_same", "n"): "schema_drift",
        ("orders_non_negative_amount", "bad_rows"): "null_spike",
        ("null_duplicate", "x"): "null_spike",
    }
    df = spark.createDataFrame(list(names), "a string, b string")
    got = df.select("a", "b", decisions.check_class(F.col("a"), F.col("b")).alias("c")).collect()
    assert {(r.a, r.b): r.c for r in got} == names


def test_unknown_outcome_counts_as_failed_and_unknown_comparator_raises(spark):
    assert rules.detect_dq_failure(dq(spark, {"check_name": "x", "metric_name": "y", "passed": None})).count() == 1
    bad = spark.range(1).select(decisions.compare(F.lit(1.0), F.lit("~"), F.lit(1.0)).alias("x"))
    with pytest.raises(Exception, match="Unsupported comparator"):
        bad.collect()


def test_decisions_match_brute_force_on_random_histories(spark):
    rnd, cases = random.Random(7), []
    for i in range(150):
        n = rnd.randint(0, 20)
        kind = rnd.choice(("noise", "constant", "zero", "negative"))
        low = {"noise": 1, "constant": 50, "zero": 0, "negative": -5}[kind]
        high = {"noise": 100, "constant": 50, "zero": 0, "negative": 5}[kind]
        history = [float(rnd.randint(low, high)) for _ in range(n)]
        cases.append((i, float(rnd.randint(-5, 400)), history))
    rows = [
        {"run_id": f"h{i}-{j}", "pipeline_key": f"p{i}", "ago": 30 - j, "rows_out": int(v), "duration_ms": int(v),
         "metadata_json": json.dumps({"null_rate": v / 100})}
        for i, _, h in cases for j, v in enumerate(h)
    ] + [
        {"run_id": f"now{i}", "pipeline_key": f"p{i}", "rows_out": int(o), "duration_ms": int(o),
         "metadata_json": json.dumps({"null_rate": o / 100})}
        for i, o, _ in cases
    ]
    frame = scored(spark, *rows).cache()
    found = {r.job_run_id for r in rules.detect_volume(frame).collect()}
    assert found == {f"now{i}" for i, o, h in cases if volume_hit(o, h)}
    slow = {r.run_id for r in rules.duration_decision(frame).filter("is_anomaly").collect()}
    assert slow == {f"now{i}" for i, o, h in cases if duration_hit(o, h)}
    nulls = {r.job_run_id for r in rules.detect_null_spike(frame).collect()}
    assert nulls == {f"now{i}" for i, o, h in cases if null_hit(o / 100, [x / 100 for x in h])}


def test_history_pools_all_tasks_and_current_is_per_task(spark):
    flags = current_vs_history(
        run(spark, {"run_id": "a", "ago": 3}, {"run_id": "b", "ago": 2, "task_name": "other"}, {"run_id": "c", "ago": 1})
    ).collect()
    assert {r.run_id: r.is_current for r in flags} == {"a": False, "b": True, "c": True}


def test_user_rule_is_appended(spark):
    inputs = rules.Inputs(scored(spark, {"rows_out": 1}), dq(spark), log(spark))
    extra = lambda i: rules.detect_job_crash(log(spark, {"run_id": "mine", "result_state": "FAILED"}))
    got = rules.all_signals(inputs, [extra]).collect()
    assert [(r.job_run_id, r.rule_rank) for r in got] == [("mine", 7)]


def signals(spark, *rows):
    base = {"pipeline_key": "p", "detected_by": "workflow", "severity": "medium", "evidence_json": "{}", "detected_at": NOW, "rule_rank": 3}
    return spark.createDataFrame([{**base, **r} for r in rows], schemas.SIGNALS)


def test_one_incident_per_run_with_primary_and_promotion(spark):
    sig = signals(
        spark,
        {"job_run_id": "1", "failure_type": "null_spike", "pipeline_key": "late_one", "evidence_json": "b"},
        {"job_run_id": "1", "failure_type": "null_spike", "evidence_json": "a"},
        {"job_run_id": "1", "failure_type": "schema_drift", "pipeline_key": "first", "rule_rank": 6},
        {"job_run_id": "2", "failure_type": "late_data"},
    )
    inc = {r.job_run_id: r for r in incidents.incidents(sig).collect()}
    assert inc["1"].primary_failure_type == "schema_drift" and inc["1"].severity == "high"
    assert inc["1"].pipeline_key == "first" and inc["2"].severity == "medium"
    unique = incidents.incident_signals(sig).collect()
    assert len(unique) == 3 and {r.evidence_json for r in unique if r.failure_type == "null_spike"} == {"a"}


def test_scorecard_halves(spark):
    truth = spark.createDataFrame([("1", "a"), ("2", "a"), ("2", "a")], "job_run_id string, failure_type string")
    found = spark.createDataFrame([("1", "a"), ("3", "a")], "job_run_id string, failure_type string")
    card = scoring.detection_scorecard(truth, found).collect()[0]
    assert card[2:] == (1, 1, 1, 0.5, 0.5)
    empty = scoring.detection_scorecard(truth.limit(0), found.limit(0)).collect()[0]
    assert (empty.precision, empty.recall) == (0.0, 0.0)


def test_existing_incidents_are_not_reopened_and_upsert_reopens(spark):
    sig = signals(spark, {"job_run_id": "1", "failure_type": "late_data"}, {"job_run_id": "2", "failure_type": "late_data"})
    found = incidents.incidents(sig)
    old = found.filter("job_run_id = '1'").withColumn("status", F.lit("RESOLVED"))
    assert [r.job_run_id for r in incidents.incident_dedup(found, old).collect()] == ["2"]
    up = {r.job_run_id: r.status for r in incidents.incident_upsert(old, found).collect()}
    assert up == {"1": "OPEN", "2": "OPEN"}


def test_status_changes_chain_over_blocks(spark):
    status = spark.createDataFrame([("i", "OPEN")], "incident_id string, status string")
    steps = ["OPEN", "INVESTIGATING", "INVESTIGATING", "RESOLVED", "OPEN"]
    reqs = [("i", f"q{n}", s, NOW + timedelta(minutes=25 * n), "me") for n, s in enumerate(steps)]
    reqs.append(("ghost", "q9", "OPEN", NOW, "me"))
    df = spark.createDataFrame(reqs, "incident_id string, request_id string, to_status string, changed_at timestamp, changed_by string")
    got = incidents.apply_status_changes(status, df).orderBy("changed_at", "incident_id").collect()
    assert [(r.from_status, r.outcome) for r in got if r.incident_id == "i"] == [
        ("OPEN", "noop"), ("OPEN", "applied"), ("INVESTIGATING", "noop"), ("INVESTIGATING", "applied"), ("RESOLVED", "applied"),
    ]
    assert [r.outcome for r in got if r.incident_id == "ghost"] == ["incident not found"]


def test_approvals_follow_state(spark):
    sig = signals(spark, {"job_run_id": "v", "failure_type": "volume_anomaly"}, {"job_run_id": "n", "failure_type": "null_spike"})
    inc = incidents.incidents(sig)
    iid = {r.job_run_id: r.incident_id for r in inc.collect()}
    status = inc.select("incident_id", "status")
    proposals = spark.createDataFrame([], "incident_id string, remediation_type string")
    d = [
        ("d1", iid["v"], "approved"), ("d2", iid["v"], "approved"), ("d3", iid["v"], "rejected"), ("d4", iid["n"], "approved"),
        ("d5", "ghost", "approved"),
    ]
    df = spark.createDataFrame(
        [(a, b, c, "op", NOW + timedelta(minutes=i)) for i, (a, b, c) in enumerate(d)],
        "decision_id string, incident_id string, decision string, decided_by string, decided_at timestamp",
    )
    got = {r.decision_id: r for r in incidents.apply_approvals(inc, status, proposals, df).collect()}
    assert got["d1"].to_status == "RESOLVED" and got["d1"].remediation_type == "diagnosis_only"
    assert got["d2"].error == "cannot approve from status RESOLVED"
    assert got["d3"].to_status == "INVESTIGATING"
    assert got["d4"].to_status == "OPEN" and got["d4"].remediation_type == "quarantine_reprocess"
    assert got["d5"].error == "incident not found"

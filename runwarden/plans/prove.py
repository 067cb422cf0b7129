"""Prove loop: perturb, seed evidence, detect and score all six classes in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden import schemas
from runwarden.functions import snapshots
from runwarden.operators import incidents, perturb, rules, scoring
from runwarden.sources.tables import PRODUCT_SCHEMA, Tables


def _telemetry_row(t: Tables, run: str, pipeline: str, hours_ago: int, **columns) -> list:
    at = t.as_of - F.make_dt_interval(F.lit(0), F.lit(hours_ago))
    values = {
        "run_id": F.lit(run),
        "pipeline_key": F.lit(pipeline),
        "task_name": F.lit("load"),
        "started_at": at,
        "ended_at": at,
        "duration_ms": F.lit(1000),
        "status": F.lit("SUCCESS"),
        "metadata_json": F.lit("{}"),
        **columns,
    }
    return [
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TASK_TELEMETRY.fields
    ]


def volume_evidence(t: Tables) -> DataFrame:
    """Three past runs at the healthy row count and one at the perturbed count, from one scan."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    counts = t.raw_order_lines.agg(
        F.count("*").alias("healthy"), F.count_if(F.pmod(key, F.lit(20)) == 0).alias("thinned")
    )
    past = [
        F.struct(*_telemetry_row(t, f"prove-volume_anomaly-hist-{i}", "orders_ingest", 3 + i, rows_out=F.col("healthy")))
        for i in range(3)
    ]
    now = F.struct(*_telemetry_row(t, "prove-volume_anomaly", "orders_ingest", 1, rows_out=F.col("thinned")))
    return counts.select(F.inline(F.array(*past, now)))


def schema_evidence(t: Tables) -> DataFrame:
    """A past run with the expected product schema and one with the drifted table's own schema."""
    drifted = perturb.perturb_schema(t.raw_products)
    expected = F.to_json(F.create_map(*[F.lit(x) for kv in PRODUCT_SCHEMA.items() for x in kv]))
    past = _telemetry_row(
        t, "prove-schema_drift-hist", "products_catalog", 3, schema_snapshot_json=expected
    )
    now = _telemetry_row(
        t, "prove-schema_drift", "products_catalog", 1, schema_snapshot_json=snapshots.snapshot_of(drifted)
    )
    seed = t.spark.range(1)
    return seed.select(F.inline(F.array(F.struct(*past), F.struct(*now))))


def crash_evidence(t: Tables) -> DataFrame:
    row = {
        "run_id": "prove-job_crash",
        "task_run_id": "prove-job_crash-task",
        "job_id": "0",
        "pipeline_key": "ops_force_fail",
        "task_key": "force_fail",
        "lifecycle_state": "TERMINATED",
        "result_state": "FAILED",
        "error_signature": "Error",
        "raw_output": "RuntimeError: forced failure",
    }
    return t.spark.range(1).select(
        *[
            (t.as_of if f.name == "collected_at" else F.lit(row[f.name])).cast(f.dataType).alias(f.name)
            for f in schemas.RAW_TASK_LOGS.fields
        ]
    )


def prove_signals(t: Tables) -> DataFrame:
    telemetry = volume_evidence(t).unionByName(schema_evidence(t))
    inputs = rules.load_inputs(telemetry, t.dq_results, crash_evidence(t), t.as_of, lookback_hours=48)
    return rules.all_signals(inputs)


def prove_incidents(t: Tables) -> DataFrame:
    return incidents.incidents(prove_signals(t))


def prove_scorecard(t: Tables) -> DataFrame:
    """Scorecards of primary classes and of signals, one row each."""
    primary = prove_incidents(t).select("job_run_id", F.col("primary_failure_type").alias("failure_type"))
    signals = prove_signals(t).select("job_run_id", "failure_type")
    cards = [
        scoring.detection_scorecard(t.truth, found).select(F.lit(name).alias("scored"), "*")
        for name, found in (("primary", primary), ("signals", signals))
    ]
    return reduce(DataFrame.unionByName, cards)

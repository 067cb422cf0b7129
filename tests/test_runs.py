"""The full loop on stored tables: perturb, check, detect, investigate, approve, repair, resolve."""

from datetime import timedelta

import pytest
from helpers import NOW
from pyspark.sql import functions as F

from runwarden import fixed, schemas
from runwarden.operators import incidents, perturb, quality
from runwarden.plans import runs
from runwarden.sources import storage
from runwarden.sources.tables import Tables


def lit(minutes):
    return F.lit(NOW + timedelta(minutes=minutes)).cast("timestamp")


def test_null_spike_from_perturbation_to_resolution(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS loop_db")
    store = storage.TableStore(spark, "loop", "loop_db")
    t = Tables(spark, "/root/testdata/sf0.001")
    store.replace("customers", t.silver_customers)
    n = store.read("customers").count()
    store.replace("customers", perturb.perturb_nulls(store.read("customers"), "email", F.col("customer_id").cast("long")))
    runs.run_checks(
        store, quality.SHIPPED_CHECKS, {"demo.silver.customers": "customers"}, "run-1", "customers_scd2", lit(-5)
    )
    opened = runs.run_detection(store, lit(0)).collect()
    assert [(r.job_run_id, r.primary_failure_type) for r in opened] == [("run-1", "null_spike")]
    assert runs.run_detection(store, lit(0)).count() == 0
    iid = opened[0].incident_id

    reports = runs.run_investigation(store, t.runbooks, t.commits, lit(1)).collect()
    assert len(reports) == 1 and reports[0].root_cause == fixed.CAUSES["null_spike"]
    assert reports[0].cited_runbook is not None and reports[0].tool_trace_len == 6
    assert store.read("agent_actions").count() == 9
    status = {r.incident_id: r.status for r in runs._status(store).collect()}
    assert status == {iid: "AWAITING_APPROVAL"}

    claimed = store.read("incidents").collect()[0]
    assert claimed.agent_started_at == NOW + timedelta(minutes=1)  # the claim is written
    assert runs.claim_incidents(store, "second", lit(2), 10).count() == 0

    params = fixed.REMEDIATIONS["null_spike"][1]
    with pytest.raises(ValueError, match="not approved"):
        runs.execute_remediation(store, iid, "quarantine_reprocess", params, "customers", lit(3))
    assert store.read("customers").count() == n

    approve = spark.createDataFrame(
        [("d1", iid, "approved", "me", NOW + timedelta(minutes=5))],
        "decision_id string, incident_id string, decision string, decided_by string, decided_at timestamp",
    )
    outcome = runs.decide(store, approve).collect()[0]
    assert outcome.remediation_type == "quarantine_reprocess" and outcome.error is None
    done = runs.execute_remediation(store, iid, outcome.remediation_type, params, "customers", lit(9))
    assert done["kept_rows"] + done["quarantined_rows"] == n and done["quarantined_rows"] == n // 2
    assert store.read("customers").filter("email IS NULL").count() == 0
    assert runs._status(store).collect()[0].status == "RESOLVED"
    assert store.read("remediation_runs").count() == 1
    for unknown in ("nobody", iid):  # no such incident; resolved already
        with pytest.raises(ValueError, match="incident"):
            runs.execute_remediation(store, unknown, "quarantine_reprocess", params, "customers", lit(10))
    assert store.read("remediation_runs").count() == 1


def test_medallion_run_counts_layers(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS med_db")
    store = storage.TableStore(spark, "med", "med_db")
    t = Tables(spark, "/root/testdata/sf0.001")
    raw = {
        "raw_customers": t.raw_customers,
        "raw_products": t.raw_products,
        "raw_orders": t._with_customer(t.raw_order_lines).select(
            "order_id", "customer_id", "product_id", "quantity", "order_ts", "status", "amount_usd"
        ),
        "raw_events": t.raw_events(),
        "raw_reviews": t.raw_reviews,
    }
    counts = runs.run_medallion(store, raw)
    assert counts["raw_orders"] == 6000 and counts["fact_orders"] == counts["orders"] == 4599
    assert counts["dim_customer"] == 150 and counts["dim_product"] == 180


def test_two_investigators_split_the_open_incidents(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS split_db")
    store = storage.TableStore(spark, "split", "split_db")
    opened = [(f"i{k}", f"r{k}", NOW + timedelta(minutes=k), "orders_ingest", "late_data", "medium", "OPEN", None, None, None) for k in range(9)]
    rows = spark.createDataFrame(opened, schemas.INCIDENTS)
    store.replace("incidents", rows)
    store.append("incident_status_events", incidents.opened_events(rows), schemas.STATUS_EVENTS)
    first = [r.incident_id for r in runs.claim_incidents(store, "a", lit(60), 4).orderBy("detected_at").collect()]
    second = [r.incident_id for r in runs.claim_incidents(store, "b", lit(61), 4).orderBy("detected_at").collect()]
    assert (first, second) == (["i0", "i1", "i2", "i3"], ["i4", "i5", "i6", "i7"])
    assert [r.incident_id for r in runs.claim_incidents(store, "a", lit(62), 4).collect()] == ["i8"]

"""Whole runs over stored tables: medallion, detection, investigation, decision and repair."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden import schemas
from runwarden.functions import decisions
from runwarden.operators import evidence, incidents, medallion, quality, remediation, retrieval, rules
from runwarden.operators.telemetry import since
from runwarden.sources.storage import TableStore
from runwarden.sources.versions import VersionedTable, claim

RAW = ("raw_customers", "raw_products", "raw_orders", "raw_events", "raw_reviews")


def run_medallion(store: TableStore, raw: Mapping[str, DataFrame] | None = None) -> dict[str, int]:
    """Bronze to gold. ``raw`` refreshes the bronze tables first; rows are counted while written."""
    counts = {name: store.counted_replace(name, df) for name, df in (raw or {}).items()}
    steps = {
        "customers": lambda: medallion.silver_customers(store.read("raw_customers")),
        "products": lambda: medallion.silver_products(store.read("raw_products")),
        "orders": lambda: medallion.silver_orders(store.read("raw_orders")),
        "events": lambda: medallion.silver_events(store.read("raw_events")),
        "reviews": lambda: medallion.silver_reviews(store.read("raw_reviews")),
        "dim_customer": lambda: medallion.dim_customer(store.read("customers")),
        "dim_product": lambda: medallion.dim_product(store.read("products")),
        "fact_orders": lambda: medallion.fact_orders(store.read("orders")),
        "daily_order_metrics": lambda: medallion.daily_order_metrics(store.read("fact_orders")),
    }
    for name, step in steps.items():
        counts[name] = store.counted_replace(name, step())
    return counts


def run_checks(
    store: TableStore, checks, tables: Mapping[str, str], run_id: str, pipeline_key: str, at: Column
) -> None:
    """Run checks and append their results; ``tables`` maps the checks' table names to stored ones."""
    frames = {name: store.read(stored) for name, stored in tables.items()}
    wanted = [c for c in checks if c.table in frames or c.query]
    found = quality.run_checks(store.spark, frames, wanted, run_id, pipeline_key, at)
    store.append("fact_dq_check", found, schemas.FACT_DQ_CHECK)


def run_detection(store: TableStore, as_of: Column, lookback_hours: float = 24) -> DataFrame:
    """Detect, then append new incidents, their signals, events and audit rows.

    Returns the newly opened incidents. Signals are written once and everything else reads them.
    """
    inputs = rules.load_inputs(
        store.read("task_telemetry", schemas.TASK_TELEMETRY),
        store.read("fact_dq_check", schemas.FACT_DQ_CHECK),
        store.read("raw_task_logs", schemas.RAW_TASK_LOGS),
        as_of,
        lookback_hours,
    )
    store.replace("detected_signals", rules.all_signals(inputs))
    signals = store.read("detected_signals")
    known = store.read("incidents", schemas.INCIDENTS)
    store.replace("opened", schemas.conform(incidents.incident_dedup(incidents.incidents(signals), known), schemas.INCIDENTS))
    opened = store.read("opened")
    old_signals = store.read("incident_signals", schemas.INCIDENT_SIGNALS)
    fresh = schemas.conform(incidents.incident_signals(signals), schemas.INCIDENT_SIGNALS)
    store.replace("incident_signals", incidents.merge_signals(old_signals, fresh))
    merged = incidents.refresh_primary(known.unionByName(opened), store.read("incident_signals"))
    store.replace("incidents", merged)
    store.append("incident_status_events", incidents.opened_events(opened), schemas.STATUS_EVENTS)
    store.append("audit_log", incidents.opened_audit(opened), schemas.AUDIT_LOG)
    return opened


def _status(store: TableStore) -> DataFrame:
    return incidents.current_status(store.read("incident_status_events", schemas.STATUS_EVENTS))


def _move(store: TableStore, ids: DataFrame, to_status: str, at: Column, by: str) -> None:
    """Request one status for many incidents and append the events that take effect."""
    requests = ids.select(
        F.concat_ws(":", "incident_id", F.lit(to_status), at.cast("string")).alias("request_id"),
        "incident_id",
        F.lit(to_status).alias("to_status"),
        at.alias("changed_at"),
        F.lit(by).alias("changed_by"),
    )
    outcome = incidents.apply_status_changes(_status(store), requests).filter(F.col("outcome") == "applied")
    store.append("incident_status_events", outcome, schemas.STATUS_EVENTS)


def claim_incidents(store: TableStore, by: str, at: Column, limit: int) -> DataFrame:
    """Claims up to ``limit`` of the oldest open incidents nobody works on; returns them with their claim.

    Claims are kept in a versioned table of their own, so several investigators can claim at once.
    """
    now = _status(store).select("incident_id", F.col("status").alias("_now"))
    rows = store.read("incidents", schemas.INCIDENTS).join(now, "incident_id").withColumn("status", F.col("_now"))
    state = rows.select("incident_id", "detected_at", "status", "agent_started_at").withColumns(
        {"claimed_by": F.lit(None).cast("string"), "updated_at": at}
    )
    when = store.spark.range(1).select(at).first()[0]
    table = VersionedTable(store.spark, store.full_name("incident_claims"), ["incident_id"], "updated_at")
    if not table.numbers():
        table.replace(state.limit(0), when, buckets=16)

    def refreshed(held: DataFrame) -> DataFrame:
        """Incidents that are new or changed their status, with the claim they have."""
        have = held.select("incident_id", *[F.col(c).alias(f"_{c}") for c in ("status", "agent_started_at", "claimed_by")])
        met = state.join(have, "incident_id", "left").where(~F.col("status").eqNullSafe(F.col("_status")))
        return met.withColumns(
            {"agent_started_at": F.coalesce("_agent_started_at", "agent_started_at"), "claimed_by": F.col("_claimed_by")}
        )

    table.update(refreshed, when)
    claim(table, by, when, limit)
    mine = table.read().where((F.col("claimed_by") == by) & (F.col("agent_started_at") == at))
    return rows.drop("_now", "agent_started_at").join(mine.select("incident_id", "agent_started_at"), "incident_id")


def run_investigation(
    store: TableStore, runbooks: DataFrame, commits: DataFrame, at: Column, minutes: int = 1, by: str = "agent",
    limit: int = 1_000,
) -> DataFrame:
    """Reports, action log and proposals for a batch of open incidents, claimed first."""
    store.replace("claimed", schemas.conform(claim_incidents(store, by, at, limit), schemas.INCIDENTS))
    todo = store.read("claimed")
    started = todo.select("incident_id", F.col("agent_started_at").alias("_started"))
    marked = store.read("incidents").join(started, "incident_id", "left")
    marked = marked.withColumn("agent_started_at", F.coalesce("_started", "agent_started_at")).drop("_started")
    store.replace("incidents", schemas.conform(marked, schemas.INCIDENTS))
    _move(store, todo, "INVESTIGATING", at, "agent")
    store.replace("runbook_embeddings", retrieval.embed_chunks(retrieval.chunk_documents(runbooks), at))
    hits = retrieval.runbook_search(store.read("runbook_embeddings"), evidence.incident_queries(todo))
    signals = store.read("incident_signals").withColumn("rule_rank", F.lit(0))
    reports = evidence.rca_report(
        todo,
        signals,
        store.read("fact_dq_check", schemas.FACT_DQ_CHECK),
        store.read("raw_task_logs", schemas.RAW_TASK_LOGS),
        store.read("task_telemetry", schemas.TASK_TELEMETRY),
        evidence.correlate_commits(todo.select("pipeline_key"), commits),
        hits,
    )
    store.replace("rca_reports", reports)
    reports = store.read("rca_reports")
    later = at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    store.append("agent_actions", evidence.agent_actions(reports, at), schemas.AGENT_ACTIONS)
    plan = evidence.remediation_plan(todo, later).join(
        reports.select("incident_id", F.col("root_cause").alias("_why")), "incident_id"
    )
    store.append("audit_log", evidence.proposal_audit(plan, F.col("_why")), schemas.AUDIT_LOG)
    _move(store, todo, "AWAITING_APPROVAL", later, "agent")
    return reports


def decide(store: TableStore, decided: DataFrame) -> DataFrame:
    """Record human decisions ``(decision_id, incident_id, decision, decided_by, decided_at)``."""
    outcome = incidents.apply_approvals(
        store.read("incidents", schemas.INCIDENTS),
        _status(store),
        incidents.latest_proposal(store.read("audit_log", schemas.AUDIT_LOG)),
        decided,
    )
    store.replace("decision_outcomes", outcome)
    outcome = store.read("decision_outcomes")
    store.append("approvals", incidents.approvals_of(outcome), schemas.APPROVALS)
    store.append("incident_status_events", incidents.events_of(outcome), schemas.STATUS_EVENTS)
    return outcome


def execute_remediation(
    store: TableStore, incident_id: str, kind: str | None, parameters: Mapping[str, str], table: str, at: Column,
    expected_schema: Mapping[str, str] | None = None, resolve: bool = True,
) -> dict[str, object]:
    """Carry out one approved repair of ``table``, record it and resolve the incident.

    Quarantine writes the flagged rows once, then both tables are cut from that version. An incident that is
    not known, resolved, or has no approval since its last repair raises before any table is touched. Without a
    kind, the one mapped to the incident's class is taken.
    """
    known = store.read("incidents", schemas.INCIDENTS).filter(F.col("incident_id") == incident_id)
    now = _status(store).filter(F.col("incident_id") == incident_id).select("status").first()
    mapped = known.select(
        decisions.remediation_type(F.col("primary_failure_type")), decisions.remediation_parameters(F.col("primary_failure_type"))
    ).first()
    if mapped is None or now is None:
        raise ValueError(f"incident not found: {incident_id}")
    if now["status"] == "RESOLVED":
        raise ValueError(f"incident is resolved: {incident_id}")
    approved = store.read("approvals", schemas.APPROVALS).filter(
        (F.col("incident_id") == incident_id) & (F.col("decision") == "approved")
    )
    repaired = store.read("remediation_runs", schemas.REMEDIATION_RUNS).filter(F.col("incident_id") == incident_id)
    since_repair = approved.agg(F.max("decided_at").alias("a")).crossJoin(repaired.agg(F.max("ran_at").alias("r")))
    if not since_repair.select(F.col("a").isNotNull() & (F.col("r").isNull() | (F.col("a") > F.col("r")))).first()[0]:
        raise ValueError(f"incident is not approved for repair: {incident_id}")
    if not kind:
        kind, parameters = mapped[0], {**(mapped[1] or {}), **parameters}
    result: dict[str, object] = {"remediation_type": kind, "table": table}
    if kind == "quarantine_reprocess":
        store.replace(f"{table}_flagged", remediation.quarantine(store.read(table), parameters))
        flagged = store.read(f"{table}_flagged")
        moved = remediation.quarantined(flagged, at)
        result["quarantined_rows"] = store.counted_replace(f"{table}_quarantine", moved)
        result["kept_rows"] = store.counted_replace(table, remediation.kept(flagged))
    elif kind == "retry_adjusted_config":
        result["adjusted_config"] = dict(parameters)
        if parameters.get("mode") == "replay_window":
            hours = int(parameters.get("lookback_hours", 168))
            replayed = store.read(table).filter(since("event_ts", at, hours))
            result["replayed_rows"] = store.counted_replace(f"{table}_replay", replayed)
    elif kind == "schema_evolution_ddl":
        df = store.read(table)
        pairs = remediation.rename_pairs(expected_schema or {}, df)
        result["restored"] = pairs
        if pairs and parameters.get("action") in ("generate_and_apply_additive", "apply_additive"):
            store.replace(table, remediation.apply_additive(df, pairs))
        have = {f.name: f.dataType.simpleString() for f in df.schema.fields}

        def as_map(columns: Mapping[str, str]) -> Column:
            flat = [F.lit(x) for pair in columns.items() for x in pair]
            return F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")

        drift = store.spark.range(1).select(
            F.lit(table).alias("table_name"), as_map(expected_schema or {}).alias("expected"), as_map(have).alias("current")
        )
        row = remediation.schema_ddl(drift).select(
            F.lit(incident_id).alias("incident_id"),
            "table_name",
            F.array_join("ddl_statements", "\n").alias("ddl_text"),
            at.alias("created_at"),
        )
        store.append("schema_evolution_proposals", row, schemas.SCHEMA_PROPOSALS)
    elif kind != "diagnosis_only":
        raise ValueError(f"unsupported remediation_type: {kind}")
    import json

    run = store.spark.range(1).select(
        F.lit(incident_id).alias("incident_id"),
        F.lit(kind).alias("remediation_type"),
        F.lit(json.dumps(result)).alias("result_json"),
        at.alias("ran_at"),
    )
    store.append("remediation_runs", run, schemas.REMEDIATION_RUNS)
    if resolve:
        one = store.spark.range(1).select(F.lit(incident_id).alias("incident_id"))
        _move(store, one, "RESOLVED", at, "remediation_job")
        audit = run.select(
            F.sha1(F.concat(F.lit("executed:"), "incident_id", F.col("ran_at").cast("string"))).alias("audit_id"),
            F.lit("remediation_job").alias("actor"),
            F.lit("remediation_executed").alias("action"),
            F.lit("incident").alias("entity_type"),
            F.col("incident_id").alias("entity_id"),
            F.col("result_json").alias("detail_json"),
            F.col("ran_at").alias("created_at"),
        )
        store.append("audit_log", audit, schemas.AUDIT_LOG)
    return result

"""Signals to incidents, and the life of an incident as append-only events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden import fixed
from runwarden.functions import decisions, text
from runwarden.operators.keyed import first_rows, latest_per_key, micros, order_number
from runwarden.operators.scan import running


def incident_id(run: Column) -> Column:
    return text.record_id(F.lit("incident"), run)


_TIES = ("detected_by", "evidence_json")


def _record_order() -> Column:
    """Order in which signals of a run are recorded: priority, then rule, then time; evidence settles ties."""
    return order_number(
        (decisions.class_priority(F.col("failure_type")), 3),
        (F.col("rule_rank"), 4),
        (micros(F.col("detected_at")), 17),
    )


def incidents(signals: DataFrame) -> DataFrame:
    """One incident per run.

    The first signal in record order gives pipeline and severity, and, as that order starts with the
    priority, the primary class. Minima combine map-side, so a run with very many signals costs one row
    per map task.
    """
    columns = ("pipeline_key", "severity", "failure_type")
    rows = first_rows(
        signals, ["job_run_id"], _record_order(), columns, _TIES, also={"detected_at": F.min("detected_at")}
    )
    promoted = F.col("failure_type").isin(*fixed.PROMOTED_CLASSES)
    return rows.select(
        incident_id(F.col("job_run_id")).alias("incident_id"),
        "job_run_id",
        "detected_at",
        "pipeline_key",
        F.col("failure_type").alias("primary_failure_type"),
        F.when(promoted, "high").otherwise(F.col("severity")).alias("severity"),
        F.lit("OPEN").alias("status"),
        F.lit(None).cast("timestamp").alias("agent_started_at"),
        F.lit(None).cast("string").alias("rca_report_path"),
        F.lit(None).cast("string").alias("linked_commit_sha"),
    )


def incident_signals(signals: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Unique (incident, class, detector); of repeated signals the first evidence is kept."""
    keys = ["job_run_id", "failure_type", "detected_by"]
    rows = first_rows(signals, keys, _record_order(), ("evidence_json", "detected_at", "rule_rank"), _TIES)
    iid = incident_id(F.col("job_run_id"))
    return rows.select(
        text.record_id(F.lit("signal"), iid, F.col("failure_type"), F.col("detected_by")).alias("signal_id"),
        iid.alias("incident_id"),
        "failure_type",
        "detected_by",
        "detected_at",
        "evidence_json",
        "rule_rank",
        *carry,
    )


def opened_events(opened: DataFrame, changed_by: str = "detection", carry: Sequence[str] = ()) -> DataFrame:
    return opened.select(
        text.record_id(F.lit("event"), F.col("incident_id"), F.lit("OPEN"), F.col("detected_at")).alias("event_id"),
        "incident_id",
        F.lit(None).cast("string").alias("from_status"),
        F.lit("OPEN").alias("to_status"),
        F.col("detected_at").alias("changed_at"),
        F.lit(changed_by).alias("changed_by"),
        *carry,
    )


def opened_audit(opened: DataFrame, changed_by: str = "detection") -> DataFrame:
    """Audit row of every opened incident."""
    detail = F.to_json(F.struct("job_run_id", "primary_failure_type", "severity"))
    return opened.select(
        text.record_id(F.lit("audit"), F.col("incident_id"), F.lit("opened")).alias("audit_id"),
        F.lit(changed_by).alias("actor"),
        F.lit("incident_opened_notify").alias("action"),
        F.lit("incident").alias("entity_type"),
        F.col("incident_id").alias("entity_id"),
        detail.alias("detail_json"),
        F.col("detected_at").alias("created_at"),
    )


def incident_dedup(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Incidents of runs that have none yet; existing ones are never touched or reopened."""
    return candidates.join(existing.select("job_run_id"), "job_run_id", "left_anti").select(*candidates.columns)


def merge_signals(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append signals whose (incident, class, detector) is new."""
    return existing.unionByName(
        incoming.join(
            existing.select("incident_id", "failure_type", "detected_by"),
            ["incident_id", "failure_type", "detected_by"],
            "left_anti",
        ).select(*existing.columns)
    )


def refresh_primary(existing: DataFrame, signals: DataFrame) -> DataFrame:
    """Recompute primary class and severity of incidents after signals were appended."""
    primary = signals.groupBy("incident_id").agg(
        F.min_by("failure_type", decisions.class_priority(F.col("failure_type"))).alias("_primary")
    )
    promoted = F.col("_primary").isin(*fixed.PROMOTED_CLASSES)
    return (
        existing.join(primary, "incident_id", "left")
        .withColumn("primary_failure_type", F.coalesce("_primary", "primary_failure_type"))
        .withColumn("severity", F.when(promoted, "high").otherwise(F.col("severity")))
        .select(*existing.columns)
    )


def incident_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new runs; for known runs take class and pipeline from the incoming row and reopen.

    Both sides hold one row per run, so they meet in one full outer join on the run.
    """
    old, new = existing.alias("o"), incoming.withColumn("_new", F.lit(True)).alias("n")
    both = old.join(new, F.col("o.job_run_id") == F.col("n.job_run_id"), "full_outer")
    overwritten = {"primary_failure_type", "pipeline_key"}
    arrived, known = F.col("n._new").isNotNull(), F.col("o.job_run_id").isNotNull()
    out = []
    for c in existing.columns:
        if c == "status":
            out.append(F.when(arrived, "OPEN").otherwise(F.col("o.status")).alias(c))
        elif c in overwritten:
            out.append(F.when(arrived, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return both.select(*out)


def incident_signals_join(incident_rows: DataFrame, signals: DataFrame) -> DataFrame:
    return signals.join(incident_rows.select("incident_id", "job_run_id"), "incident_id").select(
        "incident_id", "job_run_id", "failure_type", "detected_by"
    )


def with_signals(incident_rows: DataFrame, signals: DataFrame) -> DataFrame:
    """Every incident with the array of its signals (at most one per class and detector)."""
    packed = signals.groupBy("incident_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    decisions.class_priority(F.col("failure_type")).alias("priority"),
                    "failure_type",
                    "detected_by",
                    "evidence_json",
                )
            )
        ).alias("signals")
    )
    return incident_rows.join(packed, "incident_id", "left")


def list_incidents(incident_rows: DataFrame, status: str | None = "ALL", limit: int = 50) -> DataFrame:
    """Newest incidents of a status; the limit is the feature."""
    if status and status != "ALL":
        incident_rows = incident_rows.filter(F.col("status") == status)
    return (
        incident_rows.select(
            "incident_id",
            "job_run_id",
            "pipeline_key",
            "primary_failure_type",
            "severity",
            "status",
            "rca_report_path",
            "linked_commit_sha",
            "detected_at",
        )
        .orderBy(F.col("detected_at").desc(), "incident_id")
        .limit(limit)
    )


def unclaimed_incidents(incident_rows: DataFrame) -> DataFrame:
    return incident_rows.filter((F.col("status") == "OPEN") & F.col("agent_started_at").isNull())


def _incident(key: str) -> Column:
    """The id of an incident known by ``key``: its id or the run it belongs to."""
    return F.col(key) if key == "incident_id" else incident_id(F.col(key)).alias("incident_id")


def current_status(events: DataFrame, key: str = "incident_id") -> DataFrame:
    """Latest status of every incident from its events. ``key`` may be ``job_run_id``, which stays a column."""
    newest = latest_per_key(events, [key], [F.col("changed_at").desc(), F.col("event_id").desc()])
    return newest.select(
        *[key] if key != "incident_id" else [],
        _incident(key),
        F.col("to_status").alias("status"),
        "changed_at",
        "changed_by",
    )


def _behind_first(
    rows: DataFrame, first: DataFrame, made: Mapping[str, Column] | None
) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` (``_asked``) and the rows of ``first``, and all columns that are made behind the deal.

    ``made`` are those that ``rows`` leaves to be made; ``first`` brings its own values of them.
    """
    made = dict(made or {})
    own = {c: f"_first_{c}" for c in first.columns if c in made}
    both = rows.withColumn("_asked", F.lit(True)).unionByName(
        first.withColumnsRenamed(own).withColumn("_asked", F.lit(False)), allowMissingColumns=True
    )
    asked = {c: F.when(F.col("_asked"), value) for c, value in made.items()}
    return both, {c: value.otherwise(F.col(own[c])) if c in own else value for c, value in asked.items()}


def apply_status_changes(
    status: DataFrame, requests: DataFrame, key: str = "incident_id", made: Mapping[str, Column] | None = None
) -> DataFrame:
    """Outcome of every requested change: ``applied``, ``noop`` or ``incident not found``.

    ``status`` has one row per incident. Each request starts from the status the request before it led
    to, so a whole batch is decided at once; the status it all starts from is the first row of the incident, so
    requests move once. Both sides may name their incident by ``job_run_id`` instead, which is shorter than its id;
    it stays a column then. Columns of a request that follow from its others may be given as ``made``; they don't move.
    """
    start = status.where(F.col(key).isNotNull()).select(key, F.col("status").alias("to_status"))
    rows, made = _behind_first(requests, start, made)
    chained = running(
        rows,
        [key],
        ["_asked", "changed_at", "request_id"],
        lasts={"_before": F.col("to_status"), "_start": F.when(~F.col("_asked"), F.col("to_status"))},
        made=made,
    )
    origin = F.when(F.col("_start").isNotNull(), F.col("_before"))
    named = chained.where("_asked").withColumn("_id", _incident(key))
    return named.select(
        text.record_id(F.lit("event"), F.col("_id"), F.col("request_id")).alias("event_id"),
        F.col("_id").alias("incident_id"),
        origin.alias("from_status"),
        "to_status",
        "changed_at",
        "changed_by",
        F.when(origin.isNull(), "incident not found")
        .when(origin == F.col("to_status"), "noop")
        .otherwise("applied")
        .alias("outcome"),
        *[key] if key != "incident_id" else [],
    )


def latest_proposal(audit: DataFrame, key: str = "entity_id") -> DataFrame:
    """Newest remediation proposal of every incident. ``key`` may be ``job_run_id``, which stays a column."""
    proposals = audit.filter((F.col("action") == "propose_remediation") & (F.col("entity_type") == "incident"))
    # opened before the shuffle, so that only those of its parts move that are asked for
    detail = F.from_json(
        "detail_json", "remediation_type string, parameters map<string,string>, notes string"
    )
    opened = proposals.select(key, "created_at", "audit_id", detail.alias("d")).select(
        key,
        "created_at",
        "audit_id",
        F.col("d.remediation_type").alias("remediation_type"),
        F.col("d.parameters").alias("parameters"),
        F.col("d.notes").alias("notes"),
    )
    newest = latest_per_key(opened, [key], [F.col("created_at").desc(), F.col("audit_id").desc()])
    return newest.select(
        F.col(key).alias("incident_id") if key == "entity_id" else _incident(key),
        *[key] if key != "entity_id" else [],
        "remediation_type",
        "parameters",
        "notes",
        "created_at",
    )


def apply_approvals(
    incident_rows: DataFrame,
    status: DataFrame,
    proposals: DataFrame,
    decided: DataFrame,
    key: str = "incident_id",
    made: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Outcome of every human decision, in time order per incident.

    Approving takes the latest proposal or else the mapped remediation and is refused once resolved; a
    ``diagnosis_only`` approval resolves at once; a rejection returns the incident to investigation. What is known of
    the incident is its first row, so decisions move once. ``status``, ``proposals`` and ``decided`` may name it by
    ``job_run_id``. Columns of a decision that follow from its others may be given as ``made``; they don't move.
    """
    kind = F.nullif(F.col("remediation_type"), F.lit(""))
    proposed_for = key if key in proposals.columns else "incident_id"
    per_incident = (
        incident_rows.where("incident_id is not null")
        .select(*dict.fromkeys([proposed_for, key]), "primary_failure_type")
        .join(proposals.select(proposed_for, kind.alias("_proposed")), proposed_for, "left")
        .join(status.select(key, F.col("status").alias("_first")), key, "left")
    )
    about = per_incident.select(
        key,
        F.struct(
            F.col("_first").alias("status"),
            F.col("_proposed").alias("proposed"),
            F.coalesce("_proposed", decisions.remediation_type(F.col("primary_failure_type"))).alias("approved"),
        ).alias("_new"),
    )
    rows, made = _behind_first(decided, about, made)
    approve = F.col("decision") == "approved"
    rows = running(
        rows,
        [key],
        ["_asked", "decided_at", "decision_id"],
        lasts={
            "_incident": F.col("_new"),
            "_rejected": F.when(F.col("_asked") & ~approve, F.lit("INVESTIGATING")),
            "_decided": F.when(F.col("_asked"), F.when(approve, "RESOLVED").when(~approve, "INVESTIGATING")),
            "_either": F.when(F.col("_asked"), F.when(~approve, "INVESTIGATING").otherwise("RESOLVED")),
        },
        made=made,
    ).where("_asked")
    known = F.col("_incident").isNotNull()
    resolves = F.coalesce(F.col("_incident.approved") == "diagnosis_only", F.lit(False))
    remediation = F.when(approve, F.col("_incident.approved")).otherwise(F.col("_incident.proposed"))
    leads_to = F.when(~approve, "INVESTIGATING").when(remediation == "diagnosis_only", "RESOLVED")
    led_to = F.when(F.col("_incident.proposed") == "diagnosis_only", F.col("_either")).when(resolves, F.col("_decided"))
    before = F.coalesce(led_to.otherwise(F.col("_rejected")), F.col("_incident.status"))
    refused = approve & ~F.coalesce(before.isin(*fixed.APPROVABLE_STATUSES), F.lit(False))
    return rows.select(
        "decision_id",
        _incident(key),
        "decision",
        "decided_by",
        "decided_at",
        F.when(known & ~refused, remediation).alias("remediation_type"),
        before.alias("from_status"),
        F.when(known & ~refused, F.coalesce(leads_to, before)).alias("to_status"),
        F.when(~known, "incident not found")
        .when(refused, F.concat(F.lit("cannot approve from status "), before))
        .alias("error"),
        *[key] if key != "incident_id" else [],
    )


def approvals_of(outcomes: DataFrame, notes: str = "", carry: Sequence[str] = ()) -> DataFrame:
    return outcomes.filter(F.col("error").isNull()).select(
        text.record_id(F.lit("approval"), F.col("decision_id")).alias("approval_id"),
        "incident_id",
        "decision",
        "decided_by",
        "decided_at",
        "remediation_type",
        F.lit(notes).alias("notes"),
        *carry,
    )


def events_of(outcomes: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Status events of accepted decisions that changed the status."""
    moved = outcomes.filter(F.col("error").isNull() & (F.col("from_status") != F.col("to_status")))
    return moved.select(
        text.record_id(F.lit("event"), F.col("decision_id")).alias("event_id"),
        "incident_id",
        "from_status",
        "to_status",
        F.col("decided_at").alias("changed_at"),
        F.col("decided_by").alias("changed_by"),
        *carry,
    )


def incident_timeline(
    signals: DataFrame, events: DataFrame, actions: DataFrame, approvals: DataFrame, key: str = "incident_id"
) -> DataFrame:
    """Signals, status events, actions and approvals of all incidents, each incident's in time order.

    All four may name their incident by ``job_run_id`` instead: rows then move with the run alone, and the id by
    which they are dealt and sorted is made on either side of the shuffle.
    """

    def kind(df: DataFrame, name: str, at: str, what: Column) -> DataFrame:
        return df.select(key, F.lit(name).alias("kind"), F.col(at).alias("at"), what.alias("detail"))

    change = F.concat(F.coalesce("from_status", F.lit("")), F.lit("->"), F.col("to_status"))
    rows = (
        kind(signals, "signal", "detected_at", F.col("failure_type"))
        .unionByName(kind(events, "status", "changed_at", change))
        .unionByName(kind(actions, "action", "created_at", F.col("tool_name")))
        .unionByName(kind(approvals, "approval", "decided_at", F.col("decision")))
    )
    order = ("at", "kind", "detail")
    if key == "incident_id":
        return rows.orderBy(key, *order)
    dealt = rows.repartitionByRange(incident_id(F.col(key)), *order)
    named = dealt.select(incident_id(F.col(key)).alias("incident_id"), "kind", "at", "detail")
    return named.sortWithinPartitions("incident_id", *order)


def dim_failure_type(signals: DataFrame) -> DataFrame:
    """Failure types that were signalled, with their rank, default remediation and when they were seen."""
    failure = F.col("failure_type")
    seen = signals.groupBy("failure_type").agg(
        F.count(F.lit(1)).alias("n_signals"), F.min("detected_at").alias("first_seen"), F.max("detected_at").alias("last_seen")
    )
    return seen.withColumns(
        {"priority": decisions.class_priority(failure), "remediation_type": decisions.remediation_type(failure)}
    )

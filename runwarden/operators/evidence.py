"""Root-cause reports for all incidents in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden import fixed
from runwarden.functions import decisions, text
from runwarden.operators import incidents as inc
from runwarden.operators.keyed import ranked_top
from runwarden.operators.telemetry import run_history, schema_diff_latest


def dq_failures(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("passed")).select(
        "run_id",
        "pipeline_key",
        "check_name",
        "table_name",
        "metric_name",
        "observed_value",
        "threshold_value",
        "comparator",
        "passed",
        "checked_at",
    )


def correlate_commits(
    pipelines: DataFrame,
    commits: DataFrame,
    limit: int = 5,
    hints: Mapping[str, str] = fixed.PATH_HINTS,
    default_hint: str = fixed.DEFAULT_PATH_HINT,
    after: DataFrame | None = None,
) -> DataFrame:
    """Newest commits touching the source path of each pipeline.

    The few distinct path fragments are tested inside each commit row and the best commits are kept per
    fragment; pipelines then pick their fragment by an equality join. With ``after``
    ``(pipeline_key, last_success_at)`` only commits since the last good run are returned.
    """
    fragments = sorted({*hints.values(), default_hint})
    touched = F.filter(
        F.array(*[F.lit(h) for h in fragments]),
        lambda h: F.exists("files", lambda f: f.contains(h)),
    )
    per_hint = commits.withColumn("hint", F.explode(touched))
    known = F.create_map(*[F.lit(x) for kv in hints.items() for x in kv])
    wanted = pipelines.select("pipeline_key").distinct().withColumn(
        "hint", F.coalesce(F.element_at(known, F.col("pipeline_key")), F.lit(default_hint))
    )
    newest = [F.col("committed_at").desc(), F.col("sha")]
    rows = ranked_top(per_hint, ["hint"], newest, limit).join(wanted, "hint")
    if after is not None:
        # newest-first, so cutting at a date keeps a prefix of the ranking
        rows = rows.join(after.select("pipeline_key", "last_success_at"), "pipeline_key", "left").filter(
            F.col("last_success_at").isNull() | (F.col("committed_at") > F.col("last_success_at"))
        )
    return rows.select(
        "pipeline_key",
        F.substring("sha", 1, 12).alias("sha"),
        F.substring(F.split("message", "\n")[0], 1, 200).alias("message"),
        "author",
        "committed_at",
        F.slice("files", 1, 10).alias("files"),
        "rank",
    )


def last_success(telemetry: DataFrame) -> DataFrame:
    good = telemetry.filter(F.upper("status") == "SUCCESS")
    return good.groupBy("pipeline_key").agg(F.max("ended_at").alias("last_success_at"))


def remediation_plan(
    incident_rows: DataFrame, proposed_at: Column | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Proposed remediation of every incident by its primary class."""
    failure = F.col("primary_failure_type")
    return incident_rows.select(
        "incident_id",
        "primary_failure_type",
        decisions.remediation_type(failure).alias("remediation_type"),
        decisions.remediation_parameters(failure).alias("parameters"),
        (F.col("detected_at") if proposed_at is None else proposed_at).alias("proposed_at"),
        *carry,
    )


def proposal_audit(plan: DataFrame, notes: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Audit rows of proposals; types outside the allow-list are refused."""
    allowed = plan.filter(F.col("remediation_type").isin(*fixed.REMEDIATION_TYPES))
    detail = F.to_json(
        F.struct(
            "remediation_type",
            "parameters",
            (F.lit("") if notes is None else notes).alias("notes"),
            F.date_format("proposed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("proposed_at"),
        )
    )
    return allowed.select(
        text.record_id(F.lit("audit"), F.col("incident_id"), F.col("proposed_at"), F.col("remediation_type")).alias(
            "audit_id"
        ),
        F.lit("agent").alias("actor"),
        F.lit("propose_remediation").alias("action"),
        F.lit("incident").alias("entity_type"),
        F.col("incident_id").alias("entity_id"),
        detail.alias("detail_json"),
        F.col("proposed_at").alias("created_at"),
        *carry,
    )


def incident_queries(incident_rows: DataFrame) -> DataFrame:
    """The distinct runbook questions of all incidents: one per (class, pipeline)."""
    failure = F.coalesce("primary_failure_type", F.lit("unknown"))
    asked = incident_rows.select(failure.alias("failure"), "pipeline_key").distinct()
    return asked.select(
        F.concat_ws("|", "failure", "pipeline_key").alias("query_id"),
        F.concat_ws(" ", "failure", "pipeline_key", F.lit("incident investigation")).alias("query_text"),
        F.when(F.col("failure") != "unknown", F.col("failure")).alias("failure_type"),
    )


def _root_cause(failure: Column) -> Column:
    out = None
    for name, sentence in fixed.CAUSES.items():
        out = F.when(failure == name, sentence) if out is None else out.when(failure == name, sentence)

    def listed(column: str) -> Column:
        return F.when(
            F.col(column).isNotNull(), F.concat(F.lit("["), F.array_join(column, ", "), F.lit("]"))
        ).otherwise("None")

    drift = F.concat(
        F.lit("Schema drift detected vs prior snapshot (added="),
        listed("added"),
        F.lit(", removed="),
        listed("removed"),
        F.lit(")."),
    )
    seen = F.coalesce(
        F.nullif("log_signature", F.lit("")), F.nullif("log_excerpt", F.lit("")), F.lit("see raw_task_logs")
    )
    crash = F.concat(F.lit("Task crashed/failed at runtime ("), seen, F.lit(")."))
    other = F.concat(F.lit("Primary signal `"), failure, F.lit("` with supporting ops evidence."))
    return out.when(failure == "schema_drift", drift).when(failure == "job_crash", crash).otherwise(other)


# Most incidents ask one of a few questions; each question's rows are dealt to so many tasks.
QUESTION_PARTS = 8


def _signalled(signals: DataFrame, key: str) -> DataFrame:
    """``(key, classes, table_name)``: the classes of all signals and the table of the first that names one.

    Classes of the enumeration are bits of one number, which a hash aggregation combines; other classes and tables are
    gathered from the few signals that have them.
    """
    failure, evidence = F.col("failure_type"), F.col("evidence_json")
    # only evidence in which the name can stand, plain or escaped, is parsed
    may_name = evidence.contains("table_name") | evidence.contains("\\")
    table = F.when(may_name, F.get_json_object(evidence, "$.table_name"))
    bits = {c: 1 << i for i, c in enumerate(fixed.FAILURE_CLASSES)}
    listed = F.coalesce(failure.isin(*bits), F.lit(False))
    bit = F.element_at(F.create_map(*[F.lit(x) for kv in bits.items() for x in kv]), failure)
    known = signals.groupBy(key).agg(F.coalesce(F.bit_or(bit), F.lit(0)).alias("_bits"))
    at = [c for c in ("detected_at",) if c in signals.columns]
    first = F.struct(decisions.class_priority(failure), "rule_rank", "detected_by", *at, "evidence_json")
    rest = signals.filter(~listed | table.isNotNull()).groupBy(key).agg(
        F.collect_set(F.when(~listed, failure)).alias("_others"),
        F.min_by(table, F.when(table.isNotNull(), first)).alias("table_name"),
    )
    named = F.array_compact(F.array(*[F.when(F.col("_bits").bitwiseAND(b) != 0, c) for c, b in bits.items()]))
    classes = F.array_sort(F.concat(named, F.coalesce("_others", F.array().cast("array<string>"))))
    return known.join(rest, key, "left").select(key, classes.alias("classes"), "table_name")


def rca_report(
    incident_rows: DataFrame,
    signals: DataFrame,
    dq: DataFrame,
    logs: DataFrame,
    telemetry: DataFrame,
    commits: DataFrame,
    runbook_hits: DataFrame,
    samples: DataFrame | None = None,
    travel: DataFrame | None = None,
) -> DataFrame:
    """One report per incident.

    Evidence is reduced to one row per run, or per class and pipeline, before it meets the incidents, so none of the
    joins multiplies rows. ``signals`` may name their incident by ``job_run_id`` and may repeat: their classes and the table
    of the first that names one count, and only evidence that names a table moves. ``incident_rows`` without an
    ``incident_id`` get it from their run, behind the joins. What is known of class and pipeline is put together first and
    meets the incidents once, at the end: its texts don't move with the rows, whether or not it is small enough to be
    broadcast. ``runbook_hits`` come from :func:`incident_queries`; ``samples`` ``(table_name, sampled)`` and ``travel``
    ``(table_name, compared)`` are optional per-table texts.
    """
    failure = F.coalesce("primary_failure_type", F.lit("unknown"))
    own_id = [c for c in ("incident_id",) if c in incident_rows.columns]
    base = incident_rows.select(
        *own_id, F.col("job_run_id").alias("run_id"), "pipeline_key", failure.alias("failure")
    )

    # the run is shorter than the id, and the rows beside are by run anyway
    signalled = "run_id" if "job_run_id" in signals.columns else "incident_id"
    by_incident = _signalled(signals.withColumnsRenamed({"job_run_id": "run_id"}), signalled)
    dq_by_run = dq_failures(dq).groupBy("run_id").agg(F.count("*").alias("n_dq"))
    logs_by_run = logs.groupBy("run_id").agg(
        F.count("*").alias("n_logs"),
        F.max_by(
            F.struct("error_signature", F.substring("raw_output", 1, 1500).alias("excerpt")),
            F.struct("collected_at", "task_run_id"),
        ).alias("log"),
    ).select(
        "run_id",
        "n_logs",
        F.col("log.error_signature").alias("log_signature"),
        F.col("log.excerpt").alias("log_excerpt"),
    )

    history = run_history(telemetry, 3).groupBy("pipeline_key").agg(
        F.array_sort(
            F.collect_list(F.struct("ended_at", "run_id", "status", "rows_out", "duration_ms"))
        ).alias("history_sample")
    )
    suspects = commits.filter(F.col("rank") == 1).select("pipeline_key", F.col("sha").alias("suspect"))
    cited = runbook_hits.filter(F.col("rank") == 1).select(
        F.col("query_id").alias("_q"), F.col("runbook_path").alias("cited")
    )
    by_question = (
        base.select("failure", "pipeline_key")
        .distinct()
        .join(schema_diff_latest(telemetry), "pipeline_key", "left")
        .join(history, "pipeline_key", "left")
        .join(suspects, "pipeline_key", "left")
        .withColumn("_q", F.concat_ws("|", "failure", "pipeline_key"))
        .join(cited, "_q", "left")
        .drop("_q")
        .withColumn("_part", F.explode(F.array(*[F.lit(i) for i in range(QUESTION_PARTS)])))
    )

    rows = (
        base.join(by_incident, signalled, "left")
        .join(dq_by_run, "run_id", "left")
        .join(logs_by_run, "run_id", "left")
    )
    extra, looked_at = [], F.lit(6)  # history, checks, logs, schema, commits and runbooks
    for side, column, label in ((samples, "sampled", "sampled_bad_records="), (travel, "compared", "time_travel=")):
        if side is not None:
            rows = rows.join(side.select("table_name", column), "table_name", "left")
            extra.append(F.when(F.col(column).isNotNull(), F.concat(F.lit(label), F.substring(column, 1, 300))))
            looked_at = looked_at + F.col(column).isNotNull().cast("int")

    part = F.pmod(F.xxhash64("run_id"), F.lit(QUESTION_PARTS)).cast("int")
    rows = rows.withColumn("_part", part).join(by_question, ["failure", "pipeline_key", "_part"], "left")
    diff = F.when(F.col("reason").isNotNull(), F.col("reason")).otherwise(
        F.concat(
            F.lit("added="),
            F.array_join("added", ","),
            F.lit(" removed="),
            F.array_join("removed", ","),
            F.lit(" retyped="),
            F.array_join(F.col("type_changes.column"), ","),
        )
    )
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("primary_failure_type="), F.col("failure")),
            F.concat(F.lit("signals=["), F.array_join(F.coalesce("classes", F.array()), ", "), F.lit("]")),
            F.concat(F.lit("dq_failures="), F.coalesce("n_dq", F.lit(0)).cast("string")),
            F.concat(F.lit("task_logs="), F.coalesce("n_logs", F.lit(0)).cast("string")),
            F.concat(F.lit("schema_diff="), F.coalesce(diff, F.lit("insufficient schema snapshots"))),
            *extra,
        )
    )
    kind, params = decisions.remediation_type(F.col("failure")), decisions.remediation_parameters(F.col("failure"))
    return rows.select(
        *own_id or [inc.incident_id(F.col("run_id")).alias("incident_id")],
        F.col("run_id").alias("job_run_id"),
        "pipeline_key",
        F.concat(
            F.lit("Investigation of "),
            F.col("failure"),
            F.lit(" on pipeline `"),
            F.col("pipeline_key"),
            F.lit("` (run `"),
            F.col("run_id"),
            F.lit("`)."),
        ).alias("summary"),
        _root_cause(F.col("failure")).alias("root_cause"),
        F.col("failure").alias("root_cause_type"),
        F.concat(
            F.lit("Pipeline `"),
            F.col("pipeline_key"),
            F.lit("` and downstream consumers of its silver/gold tables."),
        ).alias("blast_radius"),
        lines.alias("evidence"),
        F.col("suspect").alias("suspected_commit_sha"),
        F.concat(kind, F.lit(": "), F.to_json(params)).alias("remediation_proposal"),
        F.col("cited").alias("cited_runbook"),
        looked_at.alias("tool_trace_len"),
        F.array_compact(
            F.array(*[F.when(F.col(c).isNotNull(), step) for c, step in TABLE_STEPS.items() if c in rows.columns])
        ).alias("table_steps"),
        "history_sample",
    )


def sample_text(bad: DataFrame, table_name: str, key: str) -> DataFrame:
    """``(table_name, sampled)`` from a bounded sample of a table's bad records: their keys."""
    keys = F.array_sort(F.collect_list(F.col(key).cast("string")))
    found = bad.agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit(f"{key}="), F.array_join(keys, ",")).alias("sampled"))
    return found.where("n > 0").select(F.lit(table_name).alias("table_name"), "sampled")


def travel_text(compared: DataFrame) -> DataFrame:
    """``(table_name, compared)`` from the comparison of two versions of a table."""
    counts = ("current_count", "earlier_count", "n_added", "n_changed", "n_removed")
    told = [F.concat(F.lit(f"{c.removeprefix('n_').removesuffix('_count')}="), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in counts]
    return compared.select("table_name", F.concat_ws(" ", *told).alias("compared"))


def rca_markdown(reports: DataFrame) -> DataFrame:
    """Reports as Markdown text."""

    def bold(label: str, value: Column) -> list[Column]:
        return [F.concat(F.lit(f"**{label}:** "), value), F.lit("")]

    def s(name: str) -> Column:
        return F.coalesce(name, F.lit(""))

    lines = [
        F.concat(F.lit("# RCA — "), s("incident_id")),
        F.lit(""),
        *bold("Summary", s("summary")),
        *bold("Root cause", s("root_cause")),
        *bold("Failure type", F.concat(F.lit("`"), s("root_cause_type"), F.lit("`"))),
        *bold("Blast radius", s("blast_radius")),
        F.lit("## Evidence"),
    ]
    tail = [
        F.lit(""),
        *bold("Suspected commit", F.coalesce("suspected_commit_sha", F.lit("n/a"))),
        *bold("Remediation proposal", s("remediation_proposal")),
        *bold("Cited runbook", s("cited_runbook")),
    ]
    bullets = F.transform("evidence", lambda e: F.concat(F.lit("- "), e))
    return reports.select(
        "incident_id", F.array_join(F.concat(F.array(*lines), bullets, F.array(*tail)), "\n").alias("markdown")
    )


# --- fixed values: what an investigation calls, in order ---------------------------
INVESTIGATION_STEPS = (
    "update_incident_status",
    "query_run_history",
    "get_dq_failures",
    "read_task_logs",
    "diff_schema",
    "correlate_github_commits",
    "sample_bad_records",
    "time_travel_compare",
    "search_runbooks",
    "save_rca_report",
    "propose_remediation",
)
TABLE_STEPS = {"sampled": "sample_bad_records", "compared": "time_travel_compare"}


def agent_actions(
    reports: DataFrame, started_at: Column, summary_chars: int = 4000, carry: Sequence[str] = ()
) -> DataFrame:
    """Action log of the investigations behind the reports, one row per step whose evidence is in the report."""
    steps = F.array(*[F.lit(s) for s in INVESTIGATION_STEPS])
    taken = F.filter(steps, lambda s: ~s.isin(*TABLE_STEPS.values()) | F.array_contains("table_steps", s))
    rows = reports.select(
        "incident_id",
        "job_run_id",
        "pipeline_key",
        "root_cause_type",
        F.array_join("evidence", "; ").alias("_out"),
        started_at.alias("_start"),
        F.posexplode(taken).alias("_i", "tool_name"),
    )
    return rows.select(
        text.record_id(F.lit("action"), F.col("incident_id"), F.col("tool_name")).alias("action_id"),
        "incident_id",
        "tool_name",
        F.to_json(F.struct("job_run_id", "pipeline_key", "root_cause_type")).alias("inputs_json"),
        F.substring("_out", 1, summary_chars).alias("outputs_summary"),
        (F.col("_start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_i").cast("decimal(18,6)"))).alias(
            "created_at"
        ),
        *carry,
    )


def synthetic_incidents(truth: DataFrame, at: Column) -> DataFrame:
    """Incidents opened straight from expected classes, to evaluate investigations."""
    return truth.select(
        inc.incident_id(F.col("job_run_id")).alias("incident_id"),
        "job_run_id",
        at.alias("detected_at"),
        "pipeline_key",
        F.col("failure_type").alias("primary_failure_type"),
        F.lit("medium").alias("severity"),
        F.lit("OPEN").alias("status"),
        F.lit(None).cast("timestamp").alias("agent_started_at"),
        F.lit(None).cast("string").alias("rca_report_path"),
        F.lit(None).cast("string").alias("linked_commit_sha"),
    )

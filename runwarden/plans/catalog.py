"""Every registered query: name -> plan over one data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runwarden import fixed
from runwarden.operators import (
    analytics,
    baselines,
    evidence,
    incidents,
    logs,
    medallion,
    perturb,
    quality,
    remediation,
    retrieval,
    rules,
    scan,
    scoring,
    telemetry,
)
from runwarden.plans import prove
from runwarden.sources import storage, versions
from runwarden.sources.tables import LAST_DAY, MIDDLE, MIRRORED_AT, MONTH_HOURS, PRODUCT_SCHEMA, Tables
from runwarden.streaming import jobs

Plan = Callable[[Tables], DataFrame]
_PLANS: dict[str, Plan] = {}


def plan(fn: Plan) -> Plan:
    _PLANS[fn.__name__] = fn
    return fn


def r6(column: str):
    return F.round(column, 6).alias(column)


# -- medallion ---------------------------------------------------------------------
@plan
def silver_customers(t: Tables) -> DataFrame:
    return t.silver_customers


@plan
def silver_products(t: Tables) -> DataFrame:
    return t.silver_products


@plan
def silver_orders(t: Tables) -> DataFrame:
    return t.silver_orders


@plan
def silver_events(t: Tables) -> DataFrame:
    return t.silver_events.withColumn("lag_minutes", r6("lag_minutes"))


@plan
def silver_reviews(t: Tables) -> DataFrame:
    return t.silver_reviews


@plan
def dim_customer_scd2(t: Tables) -> DataFrame:
    return medallion.dim_customer(t.silver_customers)


@plan
def dim_product(t: Tables) -> DataFrame:
    return medallion.dim_product(t.silver_products)


@plan
def fact_orders(t: Tables) -> DataFrame:
    return t.fact_orders


@plan
def daily_order_metrics(t: Tables) -> DataFrame:
    return medallion.daily_order_metrics(t.fact_orders)


@plan
def layer_row_counts(t: Tables) -> DataFrame:
    return medallion.layer_row_counts(
        {
            "silver.customers": t.silver_customers,
            "silver.products": t.silver_products,
            "silver.orders": t.silver_orders,
            "silver.events": t.silver_events,
            "silver.reviews": t.silver_reviews,
            "gold.dim_product": medallion.dim_product(t.silver_products),
            "gold.dim_customer": medallion.dim_customer(t.silver_customers),
            "gold.fact_orders": t.fact_orders,
            "gold.daily_order_metrics": medallion.daily_order_metrics(t.fact_orders),
            "bronze.customers": t.raw_customers,
            "bronze.products": t.raw_products,
            "bronze.orders": t.raw_order_lines,
            "bronze.events": t.raw_events(),
            "bronze.reviews": t.raw_reviews,
        }
    )


@plan
def orphan_keys(t: Tables) -> DataFrame:
    return medallion.orphan_keys(t.silver_orders, t.silver_customers, t.silver_products)


@plan
def stable_id(t: Tables) -> DataFrame:
    return t.stable_ids()


@plan
def scd2_apply(t: Tables) -> DataFrame:
    """A first load that knows six customers in seven; the next snapshot brings the others and moves some."""
    key = F.col("customer_id").cast("long")
    first = t.silver_customers.filter(key % 7 != 0)
    moved = F.when(key % 5 == 0, F.lit("MOVED")).otherwise(F.col("country"))
    later = t.silver_customers.withColumn("country", moved).withColumn(
        "updated_at", F.col("updated_at") + F.make_dt_interval(F.lit(30))
    )
    return medallion.scd2_apply(medallion.dim_customer(first), later)


# -- quality ------------------------------------------------------------------------
@plan
def dup_rate(t: Tables) -> DataFrame:
    return quality.dup_rate(t.raw_order_lines, "order_id").withColumn("duplicate_rate", r6("duplicate_rate"))


@plan
def pct_late(t: Tables) -> DataFrame:
    return quality.pct_late(medallion.silver_events(t.raw_events(60))).select(r6("pct_late"))


@plan
def dq_results(t: Tables) -> DataFrame:
    return t.dq_results.withColumn("observed_value", r6("observed_value"))


@plan
def dq_summary(t: Tables) -> DataFrame:
    return quality.dq_summary(t.dq_results)


@plan
def free_sql_checks(t: Tables) -> DataFrame:
    """Five checks written as SQL aggregates over the order lines, in one scan."""
    checks = [
        quality.Check(name, "lines", "value", comparator, limit, expression=sql)
        for name, comparator, limit, sql in (
            ("negative_amounts", "==", 0.0, "count(*) FILTER (WHERE amount_usd < 0)"),
            ("returned_share", "<=", 0.3, "count(*) FILTER (WHERE status = 'Returned') / count(*)"),
            ("median_quantity", ">=", 30.0, "percentile(quantity, 0.5)"),
            ("distinct_suppliers", ">", 5.0, "count(DISTINCT l_suppkey)"),
            ("amount_of_small_orders", "<", 1e12, "round(sum(amount_usd) FILTER (WHERE quantity < 10), 2)"),
        )
    ]
    return quality.measured(t.spark, {"lines": t.raw_order_lines}, checks).withColumn("observed_value", r6("observed_value"))


@plan
def sample_bad_records(t: Tables) -> DataFrame:
    return quality.sample_bad_records(t.holed_customers, ["customer_id"])


# -- logs ---------------------------------------------------------------------------
@plan
def task_log_explode(t: Tables) -> DataFrame:
    return logs.task_log_explode(t.payloads, "payload", F.col("collected_at"))


@plan
def error_signature(t: Tables) -> DataFrame:
    return logs.error_signature_counts(t.task_logs)


@plan
def parsed_error_signatures(t: Tables) -> DataFrame:
    return logs.parsed_error_signatures(t.task_logs)


@plan
def task_log_excerpts(t: Tables) -> DataFrame:
    return logs.task_log_excerpts(t.task_logs).select(
        "run_id", "task_run_id", "task_key", "error_signature", "raw_output_excerpt", "collected_at"
    )


@plan
def task_log_outputs(t: Tables) -> DataFrame:
    """Logs enriched with fetched task outputs; one fetch in five failed."""
    fetched = t.task_logs.select("task_run_id").distinct()
    key = F.col("task_run_id").cast("long")
    outputs = fetched.select(
        "task_run_id",
        F.when(key % 5 != 0, F.concat(F.lit(" exit code "), (key % 3).cast("string"), F.lit(" "))).alias("error"),
        F.when(key % 2 == 0, "done").alias("result"),
        F.when(key % 5 == 0, 404).alias("http_status"),
        F.when(key % 5 == 0, "not found: Error").alias("http_body"),
    )
    return logs.with_outputs(t.task_logs, outputs).select("run_id", "task_run_id", "error_signature", "raw_output")


# -- telemetry ------------------------------------------------------------------------
@plan
def current_vs_history(t: Tables) -> DataFrame:
    return telemetry.current_vs_history(t.telemetry).select(
        "run_id", "pipeline_key", "task_name", "rows_out", "ended_at", "is_current"
    )


@plan
def run_history(t: Tables) -> DataFrame:
    return telemetry.run_history(t.telemetry, 5)


@plan
def schema_diff_latest(t: Tables) -> DataFrame:
    rows = telemetry.schema_diff_latest(t.telemetry)
    changes = F.transform(
        "type_changes", lambda c: F.concat(c["column"], F.lit(":"), c["from"], F.lit(">"), c["to"])
    )
    return rows.select(
        "pipeline_key",
        "current_run_id",
        "previous_run_id",
        F.array_join("added", ",").alias("added"),
        F.array_join("removed", ",").alias("removed"),
        F.array_join(changes, ",").alias("type_changes"),
        "reason",
    )


@plan
def slow_runs(t: Tables) -> DataFrame:
    return telemetry.slow_runs(t.telemetry).withColumn("median_ms", r6("median_ms"))


@plan
def fact_job_run(t: Tables) -> DataFrame:
    return telemetry.fact_job_run(t.telemetry)


@plan
def dim_date(t: Tables) -> DataFrame:
    return telemetry.dim_date(t.telemetry)


@plan
def dim_pipeline(t: Tables) -> DataFrame:
    return telemetry.dim_pipeline(t.telemetry)


@plan
def dim_failure_type(t: Tables) -> DataFrame:
    return incidents.dim_failure_type(t.signals)


@plan
def snapshot_compare(t: Tables) -> DataFrame:
    snaps = t.table("events").select(F.date_trunc("day", "ts").alias("snapshot_ts"))
    return telemetry.snapshot_compare(snaps, t.as_of, "events")


@plan
def telemetry_rows(t: Tables) -> DataFrame:
    return jobs.recorded_telemetry(t)


# -- detection --------------------------------------------------------------------------
@plan
def detect_job_crash(t: Tables) -> DataFrame:
    return rules.detect_job_crash(t.task_logs)


@plan
def detect_status_failure(t: Tables) -> DataFrame:
    return rules.detect_status_failure(t.scored())


@plan
def detect_dq_failure(t: Tables) -> DataFrame:
    return rules.detect_dq_failure(t.dq_results).withColumn("observed_value", r6("observed_value"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("baseline", "score", "null_rate") if c in df.columns})


@plan
def detect_volume(t: Tables) -> DataFrame:
    return _rounded(rules.detect_volume(t.scored()))


@plan
def detect_volume_cold(t: Tables) -> DataFrame:
    """Three days of lookback leave too little history, so ratios decide."""
    return _rounded(rules.detect_volume(t.scored(hours=72)))


@plan
def detect_null_spike(t: Tables) -> DataFrame:
    return _rounded(rules.detect_null_spike(t.scored()))


@plan
def detect_schema_drift(t: Tables) -> DataFrame:
    found = rules.detect_schema_drift(t.scored())
    changes = F.transform(
        "type_changes", lambda c: F.concat(c["column"], F.lit(":"), c["from"], F.lit(">"), c["to"])
    )
    return found.withColumns(
        {
            "added_columns": F.array_join("added_columns", ","),
            "removed_columns": F.array_join("removed_columns", ","),
            "type_changes": F.array_join(changes, ","),
        }
    )


@plan
def duration_decision(t: Tables) -> DataFrame:
    return _rounded(rules.duration_decision(t.scored()))


@plan
def volume_iqr(t: Tables) -> DataFrame:
    found = baselines.iqr_volumes(telemetry.current_vs_history(t.telemetry))
    return found.withColumns({c: F.round(c, 6) for c in ("lower_fence", "upper_fence")})


@plan
def running_baseline(t: Tables) -> DataFrame:
    """Every run against all runs before it (per task), not only the newest one."""
    from runwarden.functions.decisions import volume_decision

    scored = baselines.running_baseline(t.telemetry).withColumn(
        "d", volume_decision(F.col("rows_out").cast("double"), F.col("baseline"))
    )
    return scored.select(
        "run_id",
        "task_name",
        "rows_out",
        F.col("baseline.n").alias("n"),
        F.round("baseline.mean", 4).alias("mean"),
        F.round("baseline.sigma", 4).alias("sigma"),
        F.col("d.mode").alias("mode"),
        F.col("d.is_anomaly").alias("is_anomaly"),
    )


@plan
def all_signals(t: Tables) -> DataFrame:
    return t.signals.drop("evidence_json")


@plan
def signal_evidence(t: Tables) -> DataFrame:
    """What the evidence of every signal tells: the task or check, and the first thing said about it."""

    def told(*names: str):
        return F.coalesce(*[F.get_json_object("evidence_json", f"$.{n}") for n in names])

    return t.signals.select(
        "job_run_id",
        "rule_rank",
        told("task_key", "check_name", "task_name", "added_columns[0]").alias("subject"),
        told("error_signature", "table_name", "error_class", "mode", "removed_columns[0]").alias("detail"),
        told("raw_output_excerpt", "metric_name", "error_message", "rows_out", "type_changes[0].column").alias("shown"),
    )


# -- incidents ----------------------------------------------------------------------------
@plan
def incident_rows(t: Tables) -> DataFrame:
    return t.incidents.select(
        "incident_id", "job_run_id", "detected_at", "pipeline_key", "primary_failure_type", "severity", "status"
    )


_PLANS["incidents"] = _PLANS.pop("incident_rows")


@plan
def incident_dedup(t: Tables) -> DataFrame:
    """Newly opened incidents when those found by task logs alone already exist."""
    return incidents.incident_dedup(t.incidents, _opened_before(t)).select(
        "incident_id", "job_run_id", "pipeline_key", "primary_failure_type", "severity"
    )


@plan
def incident_upsert(t: Tables) -> DataFrame:
    """Existing incidents with synthetic ones for every order upserted over them."""
    runs = t.table("orders").select(
        F.col("o_orderkey").cast("string").alias("job_run_id"),
        F.lit("late_data").alias("failure_type"),
        F.lit("events_clickstream").alias("pipeline_key"),
    )
    fresh = evidence.synthetic_incidents(runs, t.as_of)
    return incidents.incident_upsert(t.current_incidents, fresh).select(
        "incident_id", "job_run_id", "pipeline_key", "primary_failure_type", "severity", "status"
    )


@plan
def incident_signals_join(t: Tables) -> DataFrame:
    return incidents.incident_signals_join(t.at("incidents"), t.incident_signals)


@plan
def incident_with_signals(t: Tables) -> DataFrame:
    rows = incidents.with_signals(t.at("incidents"), t.incident_signals)
    return rows.select(
        "incident_id",
        "pipeline_key",
        F.array_join(F.col("signals.failure_type"), ",").alias("classes"),
        F.array_join(F.col("signals.detected_by"), ",").alias("detectors"),
    )


@plan
def list_incidents(t: Tables) -> DataFrame:
    return incidents.list_incidents(t.current_incidents, "OPEN")


@plan
def unclaimed_incidents(t: Tables) -> DataFrame:
    return incidents.unclaimed_incidents(t.current_incidents).select("incident_id", "job_run_id", "detected_at")


@plan
def apply_status_changes(t: Tables) -> DataFrame:
    return t.status_changes.drop("event_id", "job_run_id")


@plan
def current_status(t: Tables) -> DataFrame:
    return t.status_now.select("incident_id", "status", "changed_at")


@plan
def pipeline_status_chain(t: Tables) -> DataFrame:
    """Status requests per pipeline, all of one hour: a handful of keys own all rows, and one hour holds them."""
    flow = F.concat(F.lit("flow-"), F.col("l_partkey") % 6 % 4)
    requests = t.table("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("request_id"),
        flow.alias("flow"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus")).alias("to_status"),
        (F.col("l_orderkey") % 3600).alias("second"),
    )
    return scan.running(
        requests,
        ["flow"],
        ["second", "request_id"],
        totals={"n_before": F.lit(1).cast("long")},
        lasts={"status_before": F.col("to_status")},
    )


@plan
def latest_proposal(t: Tables) -> DataFrame:
    return incidents.latest_proposal(t.proposal_audit).select("incident_id", "remediation_type", "created_at")


@plan
def apply_approvals(t: Tables) -> DataFrame:
    return t.decided.drop("job_run_id")


def _actions(t: Tables) -> DataFrame:
    return evidence.agent_actions(_reports(t), t.as_of)


def _opened_before(t: Tables) -> DataFrame:
    """Incidents that task logs alone had opened."""
    return incidents.incidents(rules.to_signals(rules.detect_job_crash(t.task_logs), 1))


@plan
def incident_timeline(t: Tables) -> DataFrame:
    actions = evidence.agent_actions(_reports(t), t.as_of, carry=["job_run_id"])
    return incidents.incident_timeline(t.run_signals, t.all_events, actions, t.run_approvals, "job_run_id")


@plan
def detected_incidents(t: Tables) -> DataFrame:
    return scoring.detected_incidents(t.signals)


# -- scoring ----------------------------------------------------------------------------
@plan
def detection_scorecard(t: Tables) -> DataFrame:
    found = t.incidents.select("job_run_id", F.col("primary_failure_type").alias("failure_type"))
    card = scoring.detection_scorecard(t.run_truth(), found)
    return card.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@plan
def prove_matches(t: Tables) -> DataFrame:
    return scoring.prove_matches(t.truth, prove.prove_incidents(t))


@plan
def prove_scorecard(t: Tables) -> DataFrame:
    return prove.prove_scorecard(t)


@plan
def detection_summary(t: Tables) -> DataFrame:
    old = _opened_before(t)
    return scoring.detection_summary(t.signals, old)


def _grades(t: Tables) -> DataFrame:
    """Auto grades: truth known for the runs of order lines, reports for all incidents."""
    return scoring.rca_grades(_reports(t), t.run_truth())


@plan
def rca_grades(t: Tables) -> DataFrame:
    return _grades(t)


@plan
def grade_summary(t: Tables) -> DataFrame:
    """Auto grades and the human grades of the labelled documents together."""
    human = t.table("labels").select(
        F.concat(F.lit("doc-"), "doc_id").alias("incident_id"),
        F.lit("").alias("job_run_id"),
        (F.col("quality") * 2 - F.col("quality") * F.col("toxic")).cast("int").alias("score"),
        F.lit("human").alias("grader"),
        F.lit("").alias("notes"),
    )
    return scoring.grade_summary(_grades(t).unionByName(human)).withColumn("mean", r6("mean"))


@plan
def evaluation(t: Tables) -> DataFrame:
    """Investigations of incidents opened straight from expected classes, six classes and three repeats.

    One run in ten is opened under the next class, which its report must get wrong.
    """
    key = F.col("o_orderkey")
    names = F.array(*[F.lit(c) for c in fixed.FAILURE_CLASSES])
    rounds = t.table("orders").select(
        key.cast("string").alias("job_run_id"),
        F.get(names, (key % 6).cast("int")).alias("failure_type"),
        (F.floor(key / 6) % 3).alias("repeat"),
        F.lit("orders_ingest").alias("pipeline_key"),
        F.get(names, ((key + F.when(key % 10 == 0, 1).otherwise(0)) % 6).cast("int")).alias("_opened"),
    )
    opened = evidence.synthetic_incidents(rounds.withColumn("failure_type", F.col("_opened")), t.as_of)
    signals = opened.select(
        "incident_id",
        "job_run_id",
        F.col("primary_failure_type").alias("failure_type"),
        F.lit("workflow").alias("detected_by"),
        F.lit("{}").alias("evidence_json"),
        F.lit(1).alias("rule_rank"),
    )
    hits = retrieval.runbook_search(_corpus(t), evidence.incident_queries(opened), 1)
    commits = evidence.correlate_commits(opened.select("pipeline_key"), t.commits)
    reports = evidence.rca_report(opened, signals, t.dq_results, t.task_logs, t.telemetry, commits, hits)
    found = scoring.evaluation(scoring.rca_grades(reports, rounds), rounds)
    return found.withColumn("mean", r6("mean"))


@plan
def agent_accuracy(t: Tables) -> DataFrame:
    acc = scoring.agent_accuracy(_grades(t), t.at("incidents"), "job_run_id")
    return acc.withColumns({c: F.round(c, 6) for c in ("mean_score", "full_marks_rate")})


# -- retrieval ---------------------------------------------------------------------------
def _corpus(t: Tables) -> DataFrame:
    return retrieval.embed_chunks(retrieval.chunk_documents(t.runbooks), t.as_of)


def _runbook_hits(t: Tables, k: int = 3) -> DataFrame:
    return retrieval.runbook_search(_corpus(t), evidence.incident_queries(t.at("incidents")), k)


@plan
def chunk_documents(t: Tables) -> DataFrame:
    return retrieval.chunk_documents(t.runbooks)


@plan
def hash_embed(t: Tables) -> DataFrame:
    return retrieval.hash_embed(t.wide("documents"), "doc_id", "text").withColumn("weight", r6("weight"))


@plan
def cosine_topk(t: Tables) -> DataFrame:
    """The five vectors nearest to the mean vector of every label."""
    vectors = t.table("embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    )
    slots = vectors.select("label", F.posexplode("vector").alias("i", "x"))
    means = (
        slots.groupBy("label", "i")
        .agg(F.avg("x").alias("x"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    )
    queries = retrieval.vector_queries(means.select(F.col("label").alias("query_id"), "centre"), "centre")
    return retrieval.nearest(vectors, queries, "vec_id", "vector", 5).withColumn("score", r6("score"))


@plan
def runbook_search(t: Tables) -> DataFrame:
    """Top chunks for every (class, pipeline) the telemetry and job logs can raise."""
    return retrieval.runbook_search(_corpus(t), _class_pipeline_queries(t)).withColumn("score", r6("score"))


def _class_pipeline_queries(t: Tables) -> DataFrame:
    classes = F.explode(F.array(*[F.lit(c) for c in fixed.FAILURE_CLASSES]))
    pairs = t.telemetry.select("pipeline_key").distinct().select(
        classes.alias("primary_failure_type"), "pipeline_key"
    )
    return evidence.incident_queries(pairs)


@plan
def reviews_enriched(t: Tables) -> DataFrame:
    """Short function words stand in for opinion words, since the texts are invented."""
    return retrieval.reviews_enriched(
        t.silver_reviews,
        positive=("the", "and", "der", "los"),
        negative=("le", "of", "und", "que"),
        topics={"shipping": ("in", "en"), "quality": ("to", "des"), "price": ("was", "la")},
    )


# -- investigation ---------------------------------------------------------------------------
@plan
def correlate_commits(t: Tables) -> DataFrame:
    rows = evidence.correlate_commits(t.telemetry.select("pipeline_key"), t.commits)
    return rows.withColumn("files", F.array_join("files", ","))


@plan
def commits_since_success(t: Tables) -> DataFrame:
    """Only commits after the last good run of all telemetry; a healthy pipeline may have none."""
    good = evidence.last_success(t.telemetry)
    rows = evidence.correlate_commits(t.telemetry.select("pipeline_key"), t.commits, after=good)
    return rows.select("pipeline_key", "sha", "committed_at", "rank")


def _reports(t: Tables) -> DataFrame:
    logs_once = t.task_logs
    return evidence.rca_report(
        t.at("incidents").drop("incident_id"),
        t.at("signals"),
        t.at("dq_results"),
        logs_once,
        t.telemetry,
        evidence.correlate_commits(t.at("incidents").select("pipeline_key"), t.commits),
        _runbook_hits(t),
        evidence.sample_text(
            quality.sample_bad_records(t.holed_customers, ["customer_id"]), "demo.silver.customers", "customer_id"
        ),
        evidence.travel_text(t.customer_versions),
    )


@plan
def rca_report(t: Tables) -> DataFrame:
    rows = _reports(t).drop("history_sample", "table_steps")
    return rows.withColumn("evidence", F.array_join("evidence", "|"))


@plan
def rca_markdown(t: Tables) -> DataFrame:
    return evidence.rca_markdown(_reports(t))


@plan
def dq_failures(t: Tables) -> DataFrame:
    return evidence.dq_failures(t.dq_results).withColumn("observed_value", r6("observed_value"))


@plan
def remediation_plan(t: Tables) -> DataFrame:
    rows = evidence.remediation_plan(t.incidents)
    return rows.withColumn("parameters", F.to_json("parameters"))


# -- remediation -----------------------------------------------------------------------------
@plan
def quarantine_nulls(t: Tables) -> DataFrame:
    return remediation.quarantine_nulls(t.holed_customers, "email").select("customer_id", "email", "is_quarantined")


@plan
def quarantine_duplicates(t: Tables) -> DataFrame:
    return remediation.quarantine_duplicates(t.raw_order_lines, "order_id").drop("l_orderkey", "l_linenumber")


@plan
def quarantine_copies(t: Tables) -> DataFrame:
    """A doubled table goes back to one row per key."""
    flagged = remediation.quarantine_duplicates(t.doubled_orders, "order_id")
    return flagged.groupBy("is_quarantined").agg(
        F.count("*").alias("n"), F.countDistinct("order_id").alias("n_keys"), medallion.money_sum("amount_usd").alias("amount")
    )


@plan
def replay_window(t: Tables) -> DataFrame:
    return remediation.replay_window(t.silver_events, t.as_of, 168).select("event_id", "event_ts", "process_ts")


@plan
def schema_ddl(t: Tables) -> DataFrame:
    """Statements for every pipeline, comparing the current snapshot of each task with that task's oldest one."""
    tables = remediation.task_schemas(t.telemetry, t.as_of, MONTH_HOURS)
    return remediation.merged_ddl(tables).select("table_name", F.array_join("ddl_statements", "\n").alias("ddl_text"))


@plan
def apply_additive(t: Tables) -> DataFrame:
    drifted = perturb.perturb_schema(t.raw_products)
    return remediation.apply_additive(drifted, remediation.rename_pairs(PRODUCT_SCHEMA, drifted))


# -- perturbation ----------------------------------------------------------------------------
@plan
def perturb_nulls(t: Tables) -> DataFrame:
    return t.holed_customers.select("customer_id", "email")


@plan
def perturb_volume(t: Tables) -> DataFrame:
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return perturb.perturb_volume(t.raw_order_lines, key).select("order_id", "product_id", "order_ts", "amount_usd")


@plan
def perturb_duplicate(t: Tables) -> DataFrame:
    return t.doubled_orders.select("order_id", "customer_id", "amount_usd")


@plan
def perturb_schema(t: Tables) -> DataFrame:
    return perturb.perturb_schema(t.raw_products)


@plan
def perturb_late(t: Tables) -> DataFrame:
    return t.late_events.select("event_id", "event_ts", "lag_minutes")


# -- analytics -------------------------------------------------------------------------------
@plan
def mttr_minutes(t: Tables) -> DataFrame:
    return analytics.mttr_minutes(t.all_events, "job_run_id")


@plan
def incidents_by_status(t: Tables) -> DataFrame:
    return analytics.incidents_by_status(t.current_incidents)


@plan
def incidents_by_failure(t: Tables) -> DataFrame:
    return analytics.incidents_by_failure(t.incidents)


@plan
def approval_counts(t: Tables) -> DataFrame:
    return analytics.approval_counts(t.approvals).withColumn("rate", r6("rate"))


@plan
def approved_counts(t: Tables) -> DataFrame:
    return analytics.approved_counts(t.approvals)


@plan
def signals_like(t: Tables) -> DataFrame:
    return analytics.signals_like(t.signals, "prove-%", ("null_spike", "duplicate_explosion", "late_data"))


@plan
def top_tools(t: Tables) -> DataFrame:
    return analytics.top_tools(_actions(t))


@plan
def incident_trend(t: Tables) -> DataFrame:
    return analytics.incident_trend(t.incidents)


# -- rows only: sinks and streams -------------------------------------------------------------
@plan
def mirror_sync(t: Tables) -> DataFrame:
    store = storage.TableStore(t.spark, "mirrors")
    opened = t.at("incidents")  # the other copies take them from there too
    return storage.mirror_sync(
        store,
        {
            "incidents": opened,
            "incident_signals": t.incident_signals,
            "incident_status_events": t.all_events.drop("job_run_id"),
            "approvals": t.approvals,
            "agent_actions": _actions(t),
            "audit_log": t.proposal_audit.unionByName(incidents.opened_audit(opened)),
        },
    )


# -- versions ---------------------------------------------------------------------------------
@plan
def mirror_merge(t: Tables) -> DataFrame:
    """The incident mirror after one merge of the rows that changed since its first load."""
    table = t.incident_mirror()
    rows = table.read()
    table.drop()
    return rows


@plan
def mirror_as_of(t: Tables) -> DataFrame:
    """Incidents per status as the mirror stood after its first load and after the merge."""
    table = t.incident_mirror()
    parts = [
        table.read(at).groupBy("status").agg(F.count("*").alias("n")).withColumn("as_of", F.lit(at).cast("timestamp"))
        for at in (MIDDLE, MIRRORED_AT)
    ]
    table.drop()
    return parts[0].unionByName(parts[1])


@plan
def mirror_compare(t: Tables) -> DataFrame:
    """What the merge added and changed, found in the buckets that two versions don't share."""
    table = t.incident_mirror()
    found = table.compare(MIRRORED_AT, MIDDLE, "incidents")
    table.drop()
    return found


@plan
def time_travel_customers(t: Tables) -> DataFrame:
    return t.customer_versions


@plan
def claimed_incidents(t: Tables) -> DataFrame:
    """Batches of open incidents that two investigators claimed one after the other."""
    table = t.claimed_incidents()
    for agent in ("agent-1", "agent-2"):
        versions.claim(table, agent, LAST_DAY, 100)
    rows = table.read().where("claimed_by is not null")
    table.drop()
    return rows.select("incident_id", "claimed_by", "agent_started_at")


@plan
def stream_task_logs(t: Tables) -> DataFrame:
    return jobs.streamed_task_logs(t)


@plan
def stream_signals(t: Tables) -> DataFrame:
    return jobs.streamed_signals(t).select(
        "incident_id", "job_run_id", "detected_at", "pipeline_key", "primary_failure_type", "severity", "status"
    )


@plan
def stream_running_baseline(t: Tables) -> DataFrame:
    """The running baselines again, kept as state of a stream instead of computed over the history."""
    return jobs.streamed_baseline(t).select(
        "run_id",
        "task_name",
        "rows_out",
        "n",
        F.round("mean", 4).alias("mean"),
        F.round("sigma", 4).alias("sigma"),
        F.col("d.mode").alias("mode"),
        F.col("d.is_anomaly").alias("is_anomaly"),
    )


@plan
def stream_late_share(t: Tables) -> DataFrame:
    return jobs.streamed_late_share(t)


@plan
def stream_telemetry(t: Tables) -> DataFrame:
    return jobs.streamed_telemetry(t)


def _bound(fn: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Tables(spark, folder))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(fn) for name, fn in _PLANS.items()}

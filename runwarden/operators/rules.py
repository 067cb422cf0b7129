"""The rule suite: operations rows in, failure signals out.

Every ``detect_*`` returns the common signal columns plus its own typed evidence columns;
``to_signals`` packs the evidence into JSON so that the rules can be stacked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden.functions import decisions, snapshots, text
from runwarden.operators import baselines
from runwarden.operators.baselines import pipeline_name
from runwarden.operators.logs import failed
from runwarden.operators.telemetry import current_vs_history, since

COMMON = ["job_run_id", "pipeline_key", "failure_type", "detected_by", "severity", "detected_at"]


@dataclass(frozen=True)
class Inputs:
    """Rows a detection run looks at: current runs with their baselines, check results and task logs."""

    scored: DataFrame
    dq: DataFrame
    logs: DataFrame


def scored_runs(
    telemetry: DataFrame,
    as_of: Column,
    lookback_hours: float | None = 24,
    snapshot_baseline: str = "oldest",
    successful_only: bool = False,
) -> DataFrame:
    """Current runs within the lookback, each with the baselines of its pipeline's other runs."""
    if snapshot_baseline not in ("oldest", "previous"):
        raise ValueError("snapshot_baseline is 'oldest' or 'previous'")
    flagged = current_vs_history(telemetry.filter(since("ended_at", as_of, lookback_hours)))
    past = baselines.baselines(
        flagged.filter(~F.col("is_current")), successful_only, snapshot_baseline == "previous"
    )
    current = flagged.filter("is_current").withColumn("pipeline", pipeline_name())
    return current.join(past, "pipeline", "left").withColumns(
        {
            "null_rate": baselines.metadata_null_rate(),
            "snapshot": snapshots.parsed(F.col("schema_snapshot_json")),
        }
    )


def load_inputs(
    telemetry: DataFrame,
    dq: DataFrame,
    logs: DataFrame,
    as_of: Column,
    lookback_hours: float | None = 24,
    snapshot_baseline: str = "oldest",
) -> Inputs:
    """Recent rows of the three inputs."""
    return Inputs(
        scored=scored_runs(telemetry, as_of, lookback_hours, snapshot_baseline),
        dq=dq.filter(since("checked_at", as_of, lookback_hours)),
        logs=logs.filter(since("collected_at", as_of, lookback_hours)),
    )


def _signal(rows: DataFrame, failure: Column, detector: str, severity: Column, at: str, *evidence: Column | str):
    return rows.select(
        F.coalesce(F.col("run_id"), F.lit("None")).alias("job_run_id"),
        pipeline_name().alias("pipeline_key"),
        failure.alias("failure_type"),
        F.lit(detector).alias("detected_by"),
        severity.alias("severity"),
        F.col(at).alias("detected_at"),
        *evidence,
    )


def detect_job_crash(logs: DataFrame, detector: str = "poller") -> DataFrame:
    """Failed, timed-out or crashed tasks, and any log that speaks of memory exhaustion."""
    result = F.upper(F.coalesce("result_state", F.lit("")))
    lifecycle = F.upper(F.coalesce("lifecycle_state", F.lit("")))
    raw = F.lower(F.coalesce("raw_output", F.lit("")))
    oom = (
        F.lower(F.coalesce("error_signature", F.lit(""))).contains("oom")
        | raw.contains("outofmemory")
        | raw.contains("out of memory")
    )
    hits = logs.filter(failed(result, lifecycle) | oom)
    return _signal(
        hits,
        F.lit("job_crash"),
        detector,
        F.when(oom | (result == "TIMEDOUT"), "high").otherwise("medium"),
        "collected_at",
        "task_key",
        result.alias("result_state"),
        lifecycle.alias("lifecycle_state"),
        "error_signature",
        text.excerpt(F.col("raw_output"), 1000).alias("raw_output_excerpt"),
    )


def detect_dq_failure(results: DataFrame, detector: str = "workflow") -> DataFrame:
    """Checks that did not pass; an unknown outcome counts as not passed."""
    return _signal(
        results.filter(~F.coalesce("passed", F.lit(False))),
        decisions.check_class(F.col("check_name"), F.col("metric_name")),
        detector,
        F.lit("medium"),
        "checked_at",
        "check_name",
        "table_name",
        "metric_name",
        "observed_value",
        "threshold_value",
        "comparator",
    )


# -- rules over scored runs ------------------------------------------------------------


@dataclass(frozen=True)
class RunRule:
    """A rule that looks at one scored run: when it fires, and what it shows as evidence."""

    failure: str
    severity: str
    rank: int
    hit: Column
    evidence: tuple[Column, ...]


def status_rule() -> RunRule:
    return RunRule(
        "job_crash",
        "high",
        2,
        F.upper("status") == "FAILED",
        (
            F.col("task_name"),
            F.col("error_class"),
            F.col("error_message"),
            text.excerpt(F.col("stacktrace"), 1000).alias("stacktrace_excerpt"),
        ),
    )


def _decision_rule(failure: str, rank: int, shown: Column, decision: Column) -> RunRule:
    parts = ("mode", "baseline", "score", "reason")
    return RunRule(
        failure,
        "medium",
        rank,
        shown.isNotNull() & decision["is_anomaly"],
        (F.col("task_name"), shown, *[decision[p].alias(p) for p in parts]),
    )


def volume_rule() -> RunRule:
    observed = F.col("rows_out")
    return _decision_rule(
        "volume_anomaly", 4, observed, decisions.volume_decision(observed.cast("double"), F.col("volume_base"))
    )


def null_rule() -> RunRule:
    observed = F.col("null_rate")
    return _decision_rule("null_spike", 5, observed, decisions.null_rate_decision(observed, F.col("null_base")))


def drift_rule() -> RunRule:
    """Columns added, removed or retyped since the pipeline's baseline snapshot."""
    now, before = F.col("snapshot"), F.col("previous")
    new, lost = snapshots.added(now, before), snapshots.removed(now, before)
    moved = snapshots.type_changes(now, before)
    differs = (F.size(new) > 0) | (F.size(lost) > 0) | (F.size(moved) > 0)
    return RunRule(
        "schema_drift",
        "high",
        6,
        now.isNotNull() & before.isNotNull() & (F.size(before) > 0) & differs,
        (new.alias("added_columns"), lost.alias("removed_columns"), moved.alias("type_changes")),
    )


def apply_rule(scored: DataFrame, rule: RunRule, detector: str = "workflow") -> DataFrame:
    """Signals of one run rule with typed evidence columns."""
    return _signal(
        scored.filter(rule.hit), F.lit(rule.failure), detector, F.lit(rule.severity), "ended_at", *rule.evidence
    )


def detect_status_failure(scored: DataFrame) -> DataFrame:
    return apply_rule(scored, status_rule())


def detect_volume(scored: DataFrame) -> DataFrame:
    return apply_rule(scored, volume_rule())


def detect_null_spike(scored: DataFrame) -> DataFrame:
    return apply_rule(scored, null_rule())


def detect_schema_drift(scored: DataFrame) -> DataFrame:
    return apply_rule(scored, drift_rule())


def duration_decision(scored: DataFrame) -> DataFrame:
    """Duration decisions of all current runs; evidence only, never a signal of their own."""
    d = decisions.duration_decision(F.col("duration_ms").cast("double"), F.col("duration_base"))
    known = scored.filter(F.col("duration_ms").isNotNull()).withColumn("d", d)
    return known.select("run_id", F.col("pipeline").alias("pipeline_key"), "task_name", "d.*")


def run_signals(scored: DataFrame, rules: Sequence[RunRule], detector: str = "workflow") -> DataFrame:
    """Signals of several run rules from one pass: a run yields an array of those that fire."""

    def signal(rule: RunRule) -> Column:
        return F.when(
            rule.hit,
            F.struct(
                F.coalesce(F.col("run_id"), F.lit("None")).alias("job_run_id"),
                F.col("pipeline").alias("pipeline_key"),
                F.lit(rule.failure).alias("failure_type"),
                F.lit(detector).alias("detected_by"),
                F.lit(rule.severity).alias("severity"),
                F.col("ended_at").alias("detected_at"),
                _packed(rule.evidence).alias("evidence_json"),
                F.lit(rule.rank).alias("rule_rank"),
            ),
        )

    return scored.select(F.inline(F.array_compact(F.array(*[signal(r) for r in rules]))))


def _packed(evidence: Sequence[Column | str]) -> Column:
    return F.to_json(F.struct(*evidence), {"ignoreNullFields": "false"})


def to_signals(rows: DataFrame, rule_rank: int) -> DataFrame:
    """Pack everything but the common columns into ``evidence_json``."""
    evidence = [c for c in rows.columns if c not in COMMON]
    return rows.select(*COMMON, _packed(evidence).alias("evidence_json"), F.lit(rule_rank).alias("rule_rank"))


Rule = Callable[[Inputs], DataFrame]


def all_signals(inputs: Inputs, extra: Sequence[Rule] = ()) -> DataFrame:
    """Signals of the six rules, followed by those of the user's own rules.

    ``rule_rank`` gives the order of the rules: crash 1, status 2, checks 3, volume 4, nulls 5, schema 6.
    """
    parts = [
        to_signals(detect_job_crash(inputs.logs), 1),
        to_signals(detect_dq_failure(inputs.dq), 3),
        run_signals(inputs.scored, [status_rule(), volume_rule(), null_rule(), drift_rule()]),
        *[to_signals(rule(inputs), 7 + i) for i, rule in enumerate(extra)],
    ]
    return reduce(DataFrame.unionByName, parts)

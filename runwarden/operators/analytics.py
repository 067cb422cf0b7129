"""Incident history in numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mttr_minutes(events: DataFrame, key: str = "incident_id") -> DataFrame:
    """Mean minutes from first opening to first resolution, and how many incidents were resolved.

    Both times come from one grouping, so no self-join. Whole seconds are summed as integers.
    ``key`` is any column that tells incidents apart.
    """
    opened = (F.col("to_status") == "OPEN") | F.col("from_status").isNull()
    spans = events.groupBy(key).agg(
        F.min(F.when(opened, F.col("changed_at"))).alias("opened_at"),
        F.min(F.when(F.col("to_status") == "RESOLVED", F.col("changed_at"))).alias("resolved_at"),
    )
    done = spans.filter(F.col("opened_at").isNotNull() & F.col("resolved_at").isNotNull())
    seconds = F.unix_timestamp("resolved_at") - F.unix_timestamp("opened_at")
    return done.agg(
        F.round(F.avg(seconds) / 60.0, 2).alias("mttr_minutes"), F.count("*").alias("resolved_n")
    )


def incidents_by_status(incident_rows: DataFrame) -> DataFrame:
    return incident_rows.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


def incidents_by_failure(incident_rows: DataFrame) -> DataFrame:
    counts = incident_rows.groupBy("primary_failure_type").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "primary_failure_type")


def approval_counts(approvals: DataFrame) -> DataFrame:
    """Decisions with their count and share; the total is taken over the two or three counts."""
    counts = approvals.groupBy("decision").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.select("decision", "n", (F.col("n") / total.scalar()).alias("rate"))


def top_tools(actions: DataFrame, limit: int = 20) -> DataFrame:
    counts = actions.groupBy("tool_name").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "tool_name").limit(limit)


def incident_trend(incident_rows: DataFrame, grain: str = "day") -> DataFrame:
    return incident_rows.groupBy(
        F.date_trunc(grain, "detected_at").alias("period"), "primary_failure_type"
    ).agg(F.count("*").alias("n"))


def approved_counts(approvals: DataFrame) -> DataFrame:
    """Approvals per incident; incidents without any have no row."""
    approved = approvals.filter(F.col("decision") == "approved")
    return approved.groupBy("incident_id").agg(F.count("*").alias("n_approved"))


def signals_like(signals: DataFrame, run_pattern: str, classes: Sequence[str]) -> DataFrame:
    """Signals of runs that match a LIKE pattern, of the given classes; both filters reach the scan."""
    return signals.filter(F.col("job_run_id").like(run_pattern) & F.col("failure_type").isin(*classes)).select(
        "job_run_id", "failure_type", "detected_by"
    )

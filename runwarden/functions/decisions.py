"""Anomaly decisions over (observed, baseline) as struct Columns.

A baseline is the struct ``(n, mean, sigma, last)`` produced by
``runwarden.operators.baselines.baselines``; it is NULL where a pipeline has no history.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runwarden import fixed


def _decision(hit: Column, mode: Column, observed: Column, base: Column, score: Column, reason: Column) -> Column:
    return F.struct(
        F.coalesce(hit, F.lit(False)).alias("is_anomaly"),
        mode.alias("mode"),
        observed.alias("observed"),
        base.alias("baseline"),
        score.alias("score"),
        reason.alias("reason"),
    )


def _history(baseline: Column) -> tuple[Column, Column, Column, Column]:
    n = F.coalesce(baseline["n"], F.lit(0))
    sigma = F.coalesce(F.nullif(baseline["sigma"], F.lit(0.0)), F.lit(fixed.SIGMA_FLOOR))
    return n, baseline["mean"], sigma, baseline["last"]


def _mode(n: Column) -> Column:
    return F.when(n < fixed.MIN_HISTORY, "cold_start").otherwise("zscore")


def _ratio_text(label: str, ratio: Column) -> Column:
    shown = F.coalesce(F.round(ratio, 6).cast("string"), F.lit("None"))
    return F.concat(F.lit(f"{label} ratio vs previous="), shown)


def null_rate_decision(observed: Column, baseline: Column) -> Column:
    """Over 0.20 with a short history, else one-sided z of at least 3."""
    n, mean, sigma, _ = _history(baseline)
    cold = n < fixed.MIN_HISTORY
    z = (observed - mean) / sigma
    return _decision(
        F.when(cold, observed > fixed.NULL_RATE_LIMIT).otherwise(z >= fixed.Z_LIMIT),
        _mode(n),
        observed,
        F.when(cold, F.lit(fixed.NULL_RATE_LIMIT)).otherwise(mean),
        F.when(~cold, z),
        F.when(
            cold, F.format_string(f"null_rate %.3f > cold threshold {fixed.NULL_RATE_LIMIT}", observed)
        ).otherwise(F.format_string("null_rate z=%.2f (mu=%.3f, sigma=%.3f)", z, mean, sigma)),
    )


def volume_decision(observed: Column, baseline: Column) -> Column:
    """Ratio to the last run with a short history, else two-sided z of at least 3."""
    n, mean, sigma, last = _history(baseline)
    none, cold = n == 0, n < fixed.MIN_HISTORY
    ratio = F.when(last > 0, F.try_divide(observed, last))
    z = F.abs(observed - mean) / sigma
    return _decision(
        F.when(none, F.lit(False))
        .when(cold & (last <= 0), observed > 0)
        .when(cold, (ratio < fixed.VOLUME_LOW) | (ratio > fixed.VOLUME_HIGH))
        .otherwise(z >= fixed.Z_LIMIT),
        _mode(n),
        observed,
        F.when(none, F.lit(None).cast("double")).when(cold, last).otherwise(mean),
        F.when(cold, ratio).otherwise(z),
        F.when(none, F.lit("no prior volume history"))
        .when(cold, _ratio_text("volume", ratio))
        .otherwise(F.format_string("volume |z|=%.2f (mu=%.1f, sigma=%.1f)", z, mean, sigma)),
    )


def duration_decision(observed: Column, baseline: Column) -> Column:
    """More than three times the last run with a short history, else one-sided z of at least 3."""
    n, mean, sigma, last = _history(baseline)
    none, cold = n == 0, n < fixed.MIN_HISTORY
    ratio = F.when(last > 0, F.try_divide(observed, last))
    z = (observed - mean) / sigma
    return _decision(
        F.when(none, F.lit(False)).when(cold, ratio > fixed.DURATION_LIMIT).otherwise(z >= fixed.Z_LIMIT),
        _mode(n),
        observed,
        F.when(none, F.lit(None).cast("double")).when(cold, last).otherwise(mean),
        F.when(cold, ratio).otherwise(z),
        F.when(none, F.lit("no prior duration history"))
        .when(cold, _ratio_text("duration", ratio))
        .otherwise(F.format_string("duration z=%.2f (mu=%.1f, sigma=%.1f)", z, mean, sigma)),
    )


def compare(observed: Column, comparator: Column, threshold: Column) -> Column:
    """Outcome of a check; an unknown comparator fails the job."""
    return (
        F.when(comparator == "<=", observed <= threshold)
        .when(comparator == "<", observed < threshold)
        .when(comparator == ">=", observed >= threshold)
        .when(comparator == ">", observed > threshold)
        .when(comparator == "==", observed == threshold)
        .otherwise(
            F.raise_error(F.concat(F.lit("Unsupported comparator: "), F.coalesce(comparator, F.lit("NULL"))))
            .cast("boolean")
        )
    )


def check_class(check_name: Column, metric_name: Column) -> Column:
    """Failure class of a check from fragments of its name and metric, in fixed order."""
    text = F.lower(F.concat_ws(" ", F.coalesce(check_name, F.lit("None")), F.coalesce(metric_name, F.lit("None"))))
    out = None
    for fragment, failure in fixed.CHECK_FRAGMENTS:
        hit = text.contains(fragment)
        out = F.when(hit, failure) if out is None else out.when(hit, failure)
    return out.otherwise(fixed.DEFAULT_CHECK_CLASS)


def class_priority(failure: Column) -> Column:
    out = None
    for rank, name in enumerate(fixed.FAILURE_CLASSES):
        out = F.when(failure == name, rank) if out is None else out.when(failure == name, rank)
    return out.otherwise(fixed.UNRANKED_PRIORITY)


def remediation_type(failure: Column) -> Column:
    out = None
    for name, (kind, _) in fixed.REMEDIATIONS.items():
        out = F.when(failure == name, kind) if out is None else out.when(failure == name, kind)
    return out.otherwise("diagnosis_only")


def remediation_parameters(failure: Column) -> Column:
    """Parameters as a string map; unmapped classes say so."""
    out = None
    for name, (_, params) in fixed.REMEDIATIONS.items():
        pairs = F.create_map(*[F.lit(x) for kv in params.items() for x in kv])
        out = F.when(failure == name, pairs) if out is None else out.when(failure == name, pairs)
    return (
        out.when(
            failure.isNull() | (failure == ""), F.create_map(F.lit("reason"), F.lit("unknown failure type"))
        ).otherwise(F.create_map(F.lit("reason"), F.concat(F.lit("unmapped:"), failure)))
    )

"""Detection scorecards and grades of root-cause reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden import fixed
from runwarden.operators.keyed import presence


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def detection_scorecard(
    expected: DataFrame, detected: DataFrame, keys: Sequence[str] = ("job_run_id", "failure_type")
) -> DataFrame:
    """True and false positives, false negatives, precision and recall over distinct keys."""
    both = presence(expected, detected, list(keys))
    e, d = F.col("in_left"), F.col("in_right")
    counts = both.agg(
        F.count_if(e).alias("expected"),
        F.count_if(d).alias("detected"),
        F.count_if(e & d).alias("true_positives"),
        F.count_if(d & ~e).alias("false_positives"),
        F.count_if(e & ~d).alias("false_negatives"),
    )
    tp = F.col("true_positives")
    return counts.select(
        "*",
        _ratio(tp, tp + F.col("false_positives")).alias("precision"),
        _ratio(tp, tp + F.col("false_negatives")).alias("recall"),
    )


def prove_matches(expected: DataFrame, incident_rows: DataFrame) -> DataFrame:
    """For every expected (run, class): what was opened, and whether it is the expected open incident."""
    found = incident_rows.select("job_run_id", "primary_failure_type", "status")
    ok = (F.col("primary_failure_type") == F.col("failure_type")) & (F.col("status") == "OPEN")
    return expected.join(found, "job_run_id", "left").select(
        "job_run_id",
        F.col("failure_type").alias("expected"),
        "primary_failure_type",
        "status",
        F.coalesce(ok, F.lit(False)).alias("ok"),
    )


def detection_summary(signals: DataFrame, existing: DataFrame) -> DataFrame:
    """Signals evaluated and written (one per run, class and detector), runs with an incident, new ones among them.

    The ids themselves stay rows (:func:`detected_incidents`); a list of them would not fit one row.
    """
    written = signals.groupBy("job_run_id", "failure_type", "detected_by").agg(F.count("*").alias("n"))
    runs = written.groupBy("job_run_id").agg(F.sum("n").alias("n"), F.count("*").alias("w"))
    seen = runs.join(existing.select("job_run_id", F.lit(True).alias("old")), "job_run_id", "left")
    return seen.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("signals_evaluated"),
        F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("signals_written"),
        F.count("*").alias("incidents_seen"),
        F.count_if(F.col("old").isNull()).alias("incidents_created"),
    )


def detected_incidents(signals: DataFrame) -> DataFrame:
    from runwarden.operators.incidents import incident_id

    return signals.select(incident_id(F.col("job_run_id")).alias("incident_id")).distinct()


def rca_grades(reports: DataFrame, truth: DataFrame, grader: str = "auto") -> DataFrame:
    """2 = right class with at least two evidence lines, 1 = right class with less, 0 = otherwise."""
    # evidence is counted before the join: its texts don't move
    counted = reports.select(
        "incident_id", "job_run_id", "root_cause_type", F.coalesce(F.size("evidence"), F.lit(0)).alias("_lines")
    )
    graded = counted.join(truth.select("job_run_id", F.col("failure_type").alias("_want")), "job_run_id", "left")
    want = F.nullif(F.col("_want"), F.lit(""))
    right = want.isNotNull() & (F.col("root_cause_type") == want)
    lines = F.col("_lines")
    return graded.select(
        "incident_id",
        "job_run_id",
        F.when(right & (lines >= 2), 2).when(right, 1).otherwise(0).alias("score"),
        F.lit(grader).alias("grader"),
        F.when(right & (lines >= 2), F.lit("type match + evidence"))
        .when(right, F.lit("type match, thin evidence"))
        .when(
            want.isNotNull() & (lines > 0),
            F.concat(
                F.lit("expected "), want, F.lit(", got "), F.coalesce("root_cause_type", F.lit("None"))
            ),
        )
        .otherwise(F.lit("missing expected failure type"))
        .alias("notes"),
    )


def evaluation(grades: DataFrame, rounds: DataFrame) -> DataFrame:
    """Grades of evaluated investigations per expected class and repeat.

    ``rounds`` is ``(job_run_id, failure_type, repeat)``; runs without a grade count as ungraded.
    """
    rows = rounds.join(grades.select("job_run_id", "score"), "job_run_id", "left")
    return rows.groupBy("failure_type", "repeat").agg(
        F.count("score").alias("n"),
        F.count_if(F.col("score").isNull()).alias("ungraded"),
        F.avg(F.col("score").cast("double")).alias("mean"),
        F.count_if(F.col("score") == 0).alias("zeros"),
    )


def grade_summary(grades: DataFrame) -> DataFrame:
    def n_of(score: int) -> Column:
        return F.count_if(F.col("score") == score)

    counted = grades.agg(
        F.count("score").alias("n"),
        F.coalesce(F.avg(F.col("score").cast("double")), F.lit(0.0)).alias("mean"),
        n_of(0).alias("zeros"),
        n_of(1).alias("ones"),
        n_of(2).alias("twos"),
    )
    met = (
        (F.col("mean") >= fixed.GRADE_MIN_MEAN)
        & (F.col("zeros") <= fixed.GRADE_MAX_ZEROS)
        & (F.col("n") >= fixed.GRADE_MIN_N)
    )
    return counted.withColumn("exit_criteria_met", met)


def agent_accuracy(grades: DataFrame, incident_rows: DataFrame, key: str = "incident_id") -> DataFrame:
    """Grades per class of the incident they judge. ``key`` may be ``job_run_id``, by which grades are made."""
    joined = grades.join(incident_rows.select(key, "primary_failure_type"), key)
    return joined.groupBy("primary_failure_type").agg(
        F.count("*").alias("n"),
        F.avg(F.col("score").cast("double")).alias("mean_score"),
        F.avg((F.col("score") == 2).cast("double")).alias("full_marks_rate"),
    )

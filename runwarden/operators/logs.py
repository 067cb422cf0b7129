"""Failed-task logs out of nested job-run payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden import schemas
from runwarden.functions import text


def failed(result_state: Column, lifecycle: Column) -> Column:
    return F.coalesce(result_state.isin("FAILED", "TIMEDOUT"), F.lit(False)) | F.coalesce(
        lifecycle == "INTERNAL_ERROR", F.lit(False)
    )


def task_log_explode(payloads: DataFrame, payload: str, collected_at: Column) -> DataFrame:
    """One row per failed task of every payload.

    Each payload is parsed and unnested inside its own row; the two generators need no shuffle.
    """
    parsed = payloads.select(
        F.from_json(payload, schemas.RUNS_PAYLOAD).alias("p"), collected_at.alias("collected_at")
    )
    return failed_tasks(parsed.select("p.runs", "collected_at"))


def failed_tasks(listings: DataFrame) -> DataFrame:
    """One row per failed task of listings ``(runs, collected_at)`` whose runs are already typed."""
    # what an empty listing leaves has no state and is no failed task; a plain explode would build listings twice, to test them
    runs = listings.select("collected_at", F.explode_outer("runs").alias("r"))
    tasks = runs.select("collected_at", "r", F.explode_outer("r.tasks").alias("t"))
    job = F.coalesce(F.col("r.job_id").cast("string"), F.lit("None"))
    run = F.coalesce(F.col("r.run_id").cast("string"), F.lit("None"))
    message = F.coalesce(F.col("t.state.state_message"), F.lit(""))
    return tasks.filter(failed(F.col("t.state.result_state"), F.col("t.state.life_cycle_state"))).select(
        run.alias("run_id"),
        F.coalesce(F.col("t.run_id").cast("string"), run).alias("task_run_id"),
        job.alias("job_id"),
        F.coalesce(F.nullif(F.col("r.run_name"), F.lit("")), F.concat(F.lit("job_"), job)).alias("pipeline_key"),
        F.coalesce(F.col("t.task_key"), F.lit("unknown_task")).alias("task_key"),
        F.coalesce(F.col("t.state.life_cycle_state"), F.lit("")).alias("lifecycle_state"),
        F.col("t.state.result_state").alias("result_state"),
        text.error_signature(message).alias("error_signature"),
        message.alias("raw_output"),
        "collected_at",
    )


def with_outputs(logs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Append fetched task outputs ``(task_run_id, error, result, http_status, http_body)``.

    A failed fetch leaves a note in place of the output; the signature is read again from the merged text.
    """
    fetched = outputs.select("task_run_id", "error", "result", "http_status", "http_body")
    note = F.when(
        F.col("http_status").isNotNull(),
        F.concat(
            F.lit("get-output failed: "),
            F.col("http_status").cast("string"),
            F.lit(" "),
            text.excerpt(F.col("http_body"), 500),
        ),
    )
    merged = F.when(note.isNotNull(), text.merged_output(F.col("raw_output"), note)).otherwise(
        text.merged_output(F.col("raw_output"), F.col("error"), F.col("result"))
    )
    return (
        logs.join(fetched, "task_run_id", "left")
        .withColumn("raw_output", merged)
        .withColumn("error_signature", text.error_signature(F.col("raw_output")))
        .select(*logs.columns)
    )


def error_signature_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("error_signature").agg(F.count("*").alias("n"))


def parsed_error_signatures(logs: DataFrame) -> DataFrame:
    """Error class, message and failing stage read from log texts, counted per pipeline."""
    raw = F.col("raw_output")
    return (
        logs.select(
            "pipeline_key",
            text.error_class_name(raw).alias("error_class"),
            text.error_detail(raw).alias("error_message"),
            text.failing_stage(raw).alias("failing_stage"),
        )
        .groupBy("pipeline_key", "error_class", "error_message", "failing_stage")
        .agg(F.count("*").alias("n"))
    )


def task_log_excerpts(logs: DataFrame, limit: int = 20, chars: int = 1500) -> DataFrame:
    """The newest ``limit`` log lines of every run, texts cut to ``chars``."""
    from runwarden.operators.keyed import latest_per_key

    newest = latest_per_key(logs, ["run_id"], [F.col("collected_at").desc(), F.col("task_run_id")], limit)
    return newest.select(
        "run_id",
        "task_run_id",
        "task_key",
        "result_state",
        "lifecycle_state",
        "error_signature",
        F.substring("raw_output", 1, chars).alias("raw_output_excerpt"),
        "collected_at",
    )

"""Run telemetry: current and past runs, schema history, slow runs, facts and dimensions."""

from __future__ import annotations

import json
import time
import traceback
from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runwarden import fixed, schemas
from runwarden.functions import snapshots
from runwarden.operators.keyed import latest_per_key, ranked_top
from runwarden.operators.quantiles import exact_quantiles


def since(column: str, as_of: Column, hours: float | None) -> Column:
    """``column >= as_of - hours``; the bare column on the left keeps the filter pushable."""
    if hours is None:
        return F.lit(True)
    seconds = F.lit(hours * 3600).cast("decimal(18,6)")
    return F.col(column) >= as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def run_history(telemetry: DataFrame, limit: int = 10) -> DataFrame:
    """The newest runs of every pipeline."""
    newest = latest_per_key(
        telemetry, ["pipeline_key"], [F.col("ended_at").desc(), F.col("run_id").desc()], limit
    )
    return newest.select(
        "run_id",
        "pipeline_key",
        "task_name",
        "status",
        "rows_in",
        "rows_out",
        "duration_ms",
        "ended_at",
        "error_class",
    )


def current_vs_history(telemetry: DataFrame) -> DataFrame:
    """All runs with ``is_current`` set on the newest one of each (pipeline, task).

    Only the newest run's identity is taken to the other rows (one small row per task), so no task has to
    sort the whole history of a busy pipeline. A row is one task run: equal (run_id, ended_at) is the
    same run.
    """
    keys = ["_p", "_t"]
    keyed = telemetry.withColumn("_p", F.coalesce("pipeline_key", F.lit("None"))).withColumn(
        "_t", F.coalesce("task_name", F.lit("None"))
    )
    last = latest_per_key(
        keyed.select(*keys, "ended_at", "run_id"), keys, [F.col("ended_at").desc(), F.col("run_id").desc()]
    ).select(*keys, F.col("ended_at").alias("_end"), F.col("run_id").alias("_run"))
    return (
        keyed.join(last, keys, "left")
        .withColumn("is_current", (F.col("ended_at") == F.col("_end")) & (F.col("run_id") == F.col("_run")))
        .drop("_p", "_t", "_end", "_run")
    )


def schema_diff_latest(telemetry: DataFrame) -> DataFrame:
    """Difference of the two newest snapshots of every pipeline."""
    newest = ranked_top(
        telemetry.filter(F.col("schema_snapshot_json").isNotNull()).select(
            "pipeline_key", "run_id", "ended_at", "schema_snapshot_json"
        ),
        ["pipeline_key"],
        [F.col("ended_at").desc(), F.col("run_id").desc()],
        2,
    )
    pair = newest.groupBy("pipeline_key").agg(
        *[
            F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{side}_{c}")
            for r, side in ((1, "cur"), (2, "prev"))
            for c in ("run_id", "schema_snapshot_json")
        ]
    )
    cur = snapshots.parsed(F.col("cur_schema_snapshot_json"))
    prev = snapshots.parsed(F.col("prev_schema_snapshot_json"))
    both = pair.withColumn("c", cur).withColumn("p", prev)
    c, p = F.col("c"), F.col("p")
    reason = F.when(F.col("prev_run_id").isNull(), "insufficient schema snapshots").when(
        c.isNull() | p.isNull(), "unreadable schema snapshot"
    )
    return both.select(
        "pipeline_key",
        F.col("cur_run_id").alias("current_run_id"),
        F.col("prev_run_id").alias("previous_run_id"),
        snapshots.added(c, p).alias("added"),
        snapshots.removed(c, p).alias("removed"),
        snapshots.type_changes(c, p).alias("type_changes"),
        reason.alias("reason"),
    )


def slow_runs(telemetry: DataFrame, days: int = 7, factor: float = fixed.SLOW_FACTOR) -> DataFrame:
    """Runs slower than ``factor`` times the median of the pipeline's previous ``days`` calendar days.

    Durations are first counted per (pipeline, day, duration). Those counts, not the runs, are handed to
    the days they serve as baseline for, and the median is found by narrowing its interval, so the work is
    linear and no task holds the durations of a busy pipeline.
    """
    runs = telemetry.withColumn("run_date", F.to_date("ended_at"))
    counts = runs.groupBy("pipeline_key", "run_date", "duration_ms").agg(F.count("*").alias("n"))
    served = counts.withColumn(
        "run_date",
        F.explode(
            F.sequence(F.date_add("run_date", 1), F.date_add("run_date", days), F.expr("INTERVAL 1 DAY"))
        ),
    )
    served = served.groupBy("pipeline_key", "run_date", "duration_ms").agg(F.sum("n").alias("n"))
    medians = exact_quantiles(served, ["pipeline_key", "run_date"], "duration_ms", (0.5,), "n")
    medians = medians.select("pipeline_key", "run_date", F.col("q")[0].alias("median_ms"))
    return runs.join(medians, ["pipeline_key", "run_date"]).filter(
        F.col("duration_ms") > F.lit(factor) * F.col("median_ms")
    ).select("run_id", "pipeline_key", "task_name", "run_date", "duration_ms", "median_ms")


def fact_job_run(telemetry: DataFrame) -> DataFrame:
    """Fact at the grain of one task run."""
    return telemetry.select(
        "run_id",
        "pipeline_key",
        "task_name",
        F.date_format("ended_at", "yyyyMMdd").cast("int").alias("date_key"),
        "status",
        (F.upper("status") == "FAILED").alias("is_failed"),
        "duration_ms",
        "rows_in",
        "rows_out",
        "error_class",
    )


def dim_date(telemetry: DataFrame) -> DataFrame:
    """Every calendar day between the first and the last run."""
    span = telemetry.agg(F.to_date(F.min("ended_at")).alias("a"), F.to_date(F.max("ended_at")).alias("b"))
    days = span.filter(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b")).alias("date"))
    return days.select(
        F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"),
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        F.weekday("date").alias("weekday"),
    )


def dim_pipeline(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("pipeline_key").agg(
        F.min("started_at").alias("first_seen"), F.max("ended_at").alias("last_seen")
    )


def snapshot_compare(snaps: DataFrame, as_of: Column, table: str, days_back: int = 1) -> DataFrame:
    """Rows of the newest snapshot up to ``as_of`` and of the newest one a day earlier."""
    counts = snaps.filter(F.col("snapshot_ts") <= as_of).groupBy("snapshot_ts").agg(F.count("*").alias("n"))
    cutoff = as_of - F.make_dt_interval(F.lit(days_back))
    older = F.col("snapshot_ts") <= cutoff
    return counts.agg(
        F.max_by("n", "snapshot_ts").alias("current_count"),
        F.max_by("n", F.when(older, F.col("snapshot_ts"))).alias("earlier_count"),
        F.max(F.when(older, F.col("snapshot_ts"))).alias("earlier_snapshot_ts"),
    ).select(
        F.lit(table).alias("table_name"), "current_count", "earlier_count", "earlier_snapshot_ts"
    )


class TelemetryRecorder:
    """Runs a DataFrame-returning task, writes its output and records one telemetry row.

    Rows in, rows out and null share are counted while the output is written (``observe``), not by a second scan.
    """

    def __init__(self, spark: SparkSession, sink: Callable[[DataFrame], None]) -> None:
        self.spark, self.sink = spark, sink

    def run(
        self,
        run_id: str,
        pipeline_key: str,
        task_name: str,
        task: Callable[..., DataFrame],
        write: Callable[[DataFrame], None],
        null_column: str | None = None,
        inputs: Mapping[str, DataFrame] | None = None,
    ) -> None:
        """``task`` gets the tables of ``inputs`` by name; their rows, as the task reads them, are ``rows_in``."""
        row = dict.fromkeys(schemas.TASK_TELEMETRY.names)
        started, clock = datetime.now(UTC).replace(tzinfo=None), time.perf_counter()
        row.update(run_id=run_id, pipeline_key=pipeline_key, task_name=task_name, metadata_json="{}")
        try:
            read = {name: Observation() for name in inputs or {}}
            df = task(**{n: inputs[n].observe(o, F.count(F.lit(1)).alias("rows")) for n, o in read.items()})
            seen = Observation()
            null_share = (
                F.avg(F.col(null_column).isNull().cast("double")) if null_column else F.lit(None).cast("double")
            )
            write(df.observe(seen, F.count(F.lit(1)).alias("rows"), null_share.alias("null_rate")))
            got = seen.get
            row.update(
                status="SUCCESS",
                rows_in=sum(o.get["rows"] for o in read.values()) if read else None,
                rows_out=got["rows"],
                schema_snapshot_json=json.dumps({f.name: f.dataType.simpleString() for f in df.schema.fields}),
            )
            if null_column:
                row["metadata_json"] = json.dumps({"null_rate": got["null_rate"] or 0.0})
        except Exception as exc:
            row.update(
                status="FAILED",
                error_class=type(exc).__name__,
                error_message=str(exc),
                stacktrace=traceback.format_exc(),
            )
            raise
        finally:
            row.update(
                started_at=started,
                ended_at=datetime.now(UTC).replace(tzinfo=None),
                duration_ms=int((time.perf_counter() - clock) * 1000),
            )
            self.sink(self.spark.createDataFrame([row], schemas.TASK_TELEMETRY))

"""Structured Streaming forms of the poller, the detection run, the late share and the telemetry hook."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from runwarden import fixed, schemas
from runwarden.functions import decisions
from runwarden.operators import incidents, logs, medallion, rules
from runwarden.operators.telemetry import TelemetryRecorder
from runwarden.session import fresh_dir
from runwarden.sources.tables import Tables


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


# -- log poller ------------------------------------------------------------------------
def poll_task_logs(payloads: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """New payload files to failed-task rows, appended once each."""
    parsed = logs.task_log_explode(payloads, "payload", F.col("collected_at"))
    return (
        parsed.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", sink)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def payload_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = "payload string, collected_at timestamp"
    return spark.readStream.schema(schema).json(folder)


# -- detection --------------------------------------------------------------------------
def detect_stream(
    log_rows: DataFrame,
    sink: str,
    checkpoint: str,
    detect: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Each micro-batch of logs to signals; ``sink`` and ``checkpoint`` name one stream for good.

    A batch writes its own partition of ``sink``, so one that is run again after a failure or a restart
    overwrites what it wrote before, and nothing earlier is read. ``detect`` makes the signals of a batch, by
    default those of the crash rule; with the rules on telemetry and checks it looks back as far as a
    scheduled run does. Repeated signals count once when they are read: :func:`streamed_incidents`.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        found = detect(batch) if detect else rules.to_signals(rules.detect_job_crash(batch), 1)
        found.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        log_rows.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def streamed_incidents(spark: SparkSession, sink: str) -> DataFrame:
    """One incident per run from the signals of all batches; repeated signals count once."""
    return incidents.incidents(spark.read.parquet(sink).drop("batch"))


# -- late share ---------------------------------------------------------------------------
def late_share(events: DataFrame, window: str = "1 hour", limit: float = fixed.LATE_MINUTES) -> DataFrame:
    """Share of late events per event-time window; windows close 48 hours after their end."""
    lagged = events.withColumn("lag_minutes", medallion.lag_minutes("process_ts", "event_ts"))
    late = F.count_if(F.col("lag_minutes") > limit)
    return (
        lagged.withWatermark("event_ts", f"{int(limit)} minutes")
        .groupBy(F.window("event_ts", window))
        .agg(F.count("*").alias("n"), late.alias("late"))
        .select(
            F.col("window.start").alias("window_start"),
            "n",
            "late",
            (F.col("late") / F.col("n")).alias("pct_late"),
        )
    )


# -- running baselines ------------------------------------------------------------------------
_BASELINE = "pipeline_key string, task_name string, run_id string, rows_out long, n long, mean double, sigma double, last double"


def _with_baseline(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Each new run of one task with the count, mean, spread and last value of the runs before it."""
    n, total, squares, last = state.get if state.exists else (0, "0", "0", None)
    total, squares = int(total), int(squares)  # whole numbers of any size, so the sums stay exact
    out = []
    runs = pd.concat(list(frames)).sort_values(["ended_at", "run_id"])
    for run_id, value in zip(runs["run_id"], runs["rows_out"], strict=True):
        mean = total / n if n else None
        sigma = math.sqrt(max(float(squares) / n - mean * mean, 0.0)) if n else None
        value = int(value)
        out.append((*key, run_id, value, n, mean, sigma, last))
        n, total, squares, last = n + 1, total + value, squares + value * value, float(value)
    state.update((n, str(total), str(squares), last))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in _BASELINE.split(", ")])


def baseline_stream(runs: DataFrame, sink: str, checkpoint: str, repeats: str = "31 days") -> StreamingQuery:
    """Runs scored as they arrive against all earlier runs of their task, of which only four numbers are kept.

    A run that arrives again within ``repeats`` of event time counts once. Runs of one batch are taken in time
    order; a batch holds none older than those before it.
    """
    fresh = (
        runs.where("rows_out is not null")
        .withWatermark("ended_at", repeats)
        .dropDuplicatesWithinWatermark(["run_id", "task_name"])
    )
    scored = fresh.groupBy("pipeline_key", "task_name").applyInPandasWithState(
        _with_baseline, _BASELINE, "n long, total string, squares string, last double", "append", "NoTimeout"
    )
    return (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def decided(scored: DataFrame) -> DataFrame:
    """Volume decisions of scored runs."""
    baseline = F.struct("n", "mean", "sigma", "last")
    return scored.withColumn("d", decisions.volume_decision(F.col("rows_out").cast("double"), baseline))


# -- telemetry -----------------------------------------------------------------------------
class TelemetrySink:
    """Writes every micro-batch with a row about it; ``folder`` and its checkpoint name one stream for good.

    Rows older than the watermark, the newest event time of earlier batches less ``delay_minutes``, go to a table of
    their own. What earlier batches reached is read from the rows about them, so a stream that is started again goes
    on with the same watermark, and a batch that is run again writes the same files.
    """

    def __init__(self, spark: SparkSession, folder: str, pipeline_key: str, at: str, delay_minutes: int) -> None:
        self.spark, self.folder, self.pipeline_key, self.at, self.delay = spark, folder, pipeline_key, at, delay_minutes

    _ABOUT = (
        "pipeline_key string, batch long, rows_in long, rows_out long, late_rows long, newest timestamp, watermark timestamp"
    )

    def about(self) -> DataFrame:
        """One row per micro-batch so far."""
        return self.spark.read.schema(self._ABOUT).parquet(f"{self.folder}/about/batch=*")

    def _part(self, kind: str, batch_id: int) -> str:
        return f"{self.folder}/{kind}/batch={batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        reached = F.lit(None).cast("timestamp")
        if batch_id:
            before = self.about().where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
            reached = F.lit(before).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(self.delay))
        late = F.coalesce(F.col(self.at) < reached, F.lit(False))
        marked = batch.withColumn("_late", late)
        marked.write.mode("overwrite").partitionBy("_late").parquet(self._part("rows", batch_id))
        written = self.spark.read.schema(marked.schema).parquet(self._part("rows", batch_id))
        written.agg(
            F.lit(self.pipeline_key).alias("pipeline_key"),
            F.lit(batch_id).cast("long").alias("batch"),
            F.count(F.lit(1)).alias("rows_in"),
            F.count_if(~F.col("_late")).alias("rows_out"),
            F.count_if("_late").alias("late_rows"),
            F.max(self.at).alias("newest"),
            reached.alias("watermark"),
        ).coalesce(1).write.mode("overwrite").parquet(self._part("about", batch_id))

    def rows(self, schema, late: bool = False) -> DataFrame:
        """Rows of all batches, those in time or those behind the watermark."""
        kept = self.spark.read.schema(schema.add("_late", "boolean")).option("basePath", f"{self.folder}/rows")
        return kept.parquet(f"{self.folder}/rows/batch=*").where(F.col("_late") == late).drop("_late", "batch")


def watched(events: DataFrame, sink: TelemetrySink, checkpoint: str) -> StreamingQuery:
    return (
        events.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# -- runs over the given tables, to completion -----------------------------------------------
def _streamed(t: Tables, name: str) -> DataFrame:
    """A given table as a stream of its file."""
    return t.spark.readStream.schema(schemas.GIVEN[name]).parquet(f"{t.folder}/{name}*.parquet")


class _StreamTables(Tables):
    """The same derivations with tables read as streams."""

    def table(self, name: str) -> DataFrame:
        return _streamed(Tables(self.spark, self.folder), name)


def streamed_task_logs(t: Tables) -> DataFrame:
    sink, state = fresh_dir(t.spark, "stream/logs"), fresh_dir(t.spark, "stream/state")
    _finish(poll_task_logs(_StreamTables(t.spark, t.folder).payloads, sink, state))
    return t.spark.read.schema(schemas.RAW_TASK_LOGS).parquet(sink)


def streamed_signals(t: Tables) -> DataFrame:
    """Incidents of a stream over the job logs and of one scheduled pass over telemetry and checks.

    A batch sees only its own logs; the rules on telemetry and checks run once, beside the stream.
    """
    live = _StreamTables(t.spark, t.folder)
    sink, state = fresh_dir(t.spark, "stream/signals"), fresh_dir(t.spark, "stream/state")
    _finish(detect_stream(logs.task_log_explode(live.payloads, "payload", F.col("collected_at")), sink, state))
    scheduled = rules.all_signals(dataclasses.replace(t.inputs(), logs=t.task_logs.limit(0)))
    scheduled.write.parquet(f"{sink}/batch=scheduled")
    return schemas.conform(streamed_incidents(t.spark, sink), schemas.INCIDENTS)


def streamed_late_share(t: Tables) -> DataFrame:
    sink, state = fresh_dir(t.spark, "stream/late"), fresh_dir(t.spark, "stream/state")
    live = _StreamTables(t.spark, t.folder).raw_events(60)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = (
        late_share(live)
        .writeStream.outputMode("update")
        .foreachBatch(handle)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    _finish(query)
    updates = t.spark.read.parquet(f"{sink}/batch=*")
    from runwarden.operators.keyed import latest_per_key

    newest = latest_per_key(updates, ["window_start"], [F.col("batch").desc()])
    return newest.select("window_start", "n", "late", F.round("pct_late", 6).alias("pct_late"))


ARRIVALS = 4  # parts in which the month's events reach the stream; one event in fifty comes a part later


def streamed_telemetry(t: Tables) -> DataFrame:
    """What every micro-batch of a stream over the events brought, counted by the stream itself.

    Events arrive in parts by day of the month, one file folder after the other.
    """
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / 8) + (F.col("event_id") % 50 == 0).cast("int"), F.lit(ARRIVALS - 1))
    inbox = fresh_dir(t.spark, "stream/inbox")
    events = t.table("events").withColumn("_part", part)
    sink = TelemetrySink(t.spark, fresh_dir(t.spark, "stream/watched"), "events_clickstream", "ts", fixed.LATE_MINUTES)
    state = fresh_dir(t.spark, "stream/state")
    schema = schemas.GIVEN["events"]
    for k in range(ARRIVALS):
        events.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(inbox)
        _finish(watched(t.spark.readStream.schema(schema).parquet(inbox), sink, state))
    return sink.about()


def streamed_baseline(t: Tables) -> DataFrame:
    """Every run of the month scored when it arrived: a week at a time, the week before sent once more."""
    inbox, sink, state = (fresh_dir(t.spark, f"stream/{x}") for x in ("inbox", "baselines", "state"))
    runs = t.at("telemetry").withColumn("_week", F.least(F.floor((F.dayofmonth("ended_at") - 1) / 7), F.lit(ARRIVALS - 1)))
    schema = t.at("telemetry").schema
    for week in range(ARRIVALS):
        sent = runs.where((F.col("_week") == week) | (F.col("_week") == week - 1)).drop("_week")
        sent.write.mode("append").parquet(inbox)
        _finish(baseline_stream(t.spark.readStream.schema(schema).parquet(inbox), sink, state))
    return decided(t.spark.read.schema(_BASELINE).parquet(sink))


def recorded_telemetry(t: Tables) -> DataFrame:
    """Telemetry rows of the silver layer's tasks over the given tables, with the rows they read and wrote."""
    out: list[DataFrame] = []
    recorder = TelemetryRecorder(t.spark, out.append)
    tasks = (
        ("customers", medallion.silver_customers, t.landed_customers, "email"),
        ("products", medallion.silver_products, t.landed_products, "sku"),
        ("events", medallion.silver_events, t.landed_events, "product_id"),
        ("reviews", medallion.silver_reviews, t.landed_reviews, "review_text"),
    )
    for name, task, raw, column in tasks:
        path = fresh_dir(t.spark, f"recorded/{name}")
        recorder.run(f"{name}-run", name, "load", task, lambda df, p=path: df.write.parquet(p), column, {"raw": raw})
    rows = reduce(DataFrame.unionByName, out)
    null_rate = F.round(F.get_json_object("metadata_json", "$.null_rate").cast("double"), 6)
    columns = F.array_join(F.map_keys(F.from_json("schema_snapshot_json", "map<string,string>")), ",")
    return rows.select(
        "run_id", "pipeline_key", "task_name", "status", "rows_in", "rows_out", null_rate.alias("null_rate"), columns.alias("columns")
    )

"""Per-pipeline baselines of past runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden import fixed
from runwarden.functions import snapshots
from runwarden.operators.keyed import micros, order_number
from runwarden.operators.quantiles import exact_quantiles
from runwarden.operators.scan import running


def pipeline_name(column: str = "pipeline_key") -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))


def metadata_null_rate(metadata: str = "metadata_json") -> Column:
    """``null_rate`` of the metadata; NULL when absent or when the JSON cannot be read."""
    return F.from_json(F.coalesce(F.nullif(F.col(metadata), F.lit("")), F.lit("{}")), "null_rate double")["null_rate"]


def _run_order() -> Column:
    """Newer runs sort later; of runs that ended at the same time, by a hash of their id."""
    return order_number((micros(F.col("ended_at")), 17), (F.pmod(F.xxhash64("run_id"), F.lit(10**18)), 18))


def _numeric(value: Column) -> Column:
    """(n, mean, population sigma, last value) of the non-NULL values of a group."""
    v = value.cast("double")
    return F.struct(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("sigma"),
        F.max_by(v, F.when(v.isNotNull(), _run_order())).alias("last"),
    )


def baselines(history: DataFrame, successful_only: bool = False, newest_snapshot: bool = False) -> DataFrame:
    """All baselines of a pipeline's past runs.

    ``(pipeline, volume, null_rate, duration, previous)``; ``previous`` is the oldest readable schema
    snapshot, or the newest one. Everything combines map-side, so a pipeline with very many runs costs
    one row per map task, and one per distinct snapshot.
    """
    rows = history.filter(F.upper("status") == "SUCCESS") if successful_only else history
    rows = rows.withColumn("pipeline", pipeline_name())
    numbers = rows.groupBy("pipeline").agg(
        _numeric(F.col("rows_out")).alias("volume_base"),
        _numeric(metadata_null_rate()).alias("null_base"),
        _numeric(F.col("duration_ms")).alias("duration_base"),
    )
    pick = F.max if newest_snapshot else F.min
    snap = F.nullif("schema_snapshot_json", F.lit(""))
    seen = rows.select("pipeline", snap.alias("_snap"), _run_order().alias("_at")).where("_snap is not null")
    seen = seen.groupBy("pipeline", "_snap").agg(pick("_at").alias("_at"))
    seen = seen.where(F.try_parse_json("_snap").isNotNull())
    listed = F.array_sort(F.collect_list(F.struct("_at", "_snap")))
    chosen = seen.groupBy("pipeline").agg(F.element_at(listed, -1 if newest_snapshot else 1)["_snap"].alias("_snap"))
    return numbers.join(chosen, "pipeline", "left").withColumn("previous", snapshots.parsed(F.col("_snap"))).drop("_snap")


def iqr_volumes(telemetry: DataFrame, fence: float = fixed.IQR_FENCE) -> DataFrame:
    """Runs whose volume lies outside the quartile fences of the pipeline's past runs.

    Takes rows flagged by ``current_vs_history``.
    """
    past = telemetry.filter(~F.col("is_current") & F.col("rows_out").isNotNull())
    counts = past.groupBy(pipeline_name().alias("pipeline"), "rows_out").agg(F.count("*").alias("n"))
    quartiles = exact_quantiles(counts, ["pipeline"], "rows_out", (0.25, 0.75), "n")
    q1, q3 = F.col("q")[0], F.col("q")[1]
    bounds = quartiles.select(
        "pipeline",
        (q1 - fence * (q3 - q1)).alias("lower_fence"),
        (q3 + fence * (q3 - q1)).alias("upper_fence"),
    )
    current = telemetry.filter(F.col("is_current") & F.col("rows_out").isNotNull())
    scored = current.withColumn("pipeline", pipeline_name()).join(bounds, "pipeline", "left")
    return scored.select(
        "run_id",
        F.col("pipeline").alias("pipeline_key"),
        "rows_out",
        "lower_fence",
        "upper_fence",
        F.coalesce(
            (F.col("rows_out") < F.col("lower_fence")) | (F.col("rows_out") > F.col("upper_fence")), F.lit(False)
        ).alias("is_anomaly"),
    )


def running_baseline(telemetry: DataFrame, value: str = "rows_out") -> DataFrame:
    """Every run with the baseline of the runs before it, per (pipeline, task).

    Sums of whole numbers are exact, so it doesn't show how they are grouped along a long history.
    """
    v = F.col(value).cast("decimal(38,0)")
    rows = running(
        telemetry.filter(F.col(value).isNotNull()),
        ["pipeline_key", "task_name"],
        ["ended_at", "run_id"],
        totals={"_n": F.lit(1).cast("long"), "_s": v, "_q": v * v},
        lasts={"_l": F.col(value)},
    )
    n, s, q = F.col("_n"), F.col("_s").cast("double"), F.col("_q").cast("double")
    mean = F.try_divide(s, n.cast("double"))
    spread = F.when(n > 0, F.greatest(F.try_divide(q, n.cast("double")) - mean * mean, F.lit(0.0)))
    return rows.withColumn(
        "baseline",
        F.struct(
            n.alias("n"), mean.alias("mean"), F.sqrt(spread).alias("sigma"), F.col("_l").cast("double").alias("last")
        ),
    ).drop("_n", "_s", "_q", "_l")

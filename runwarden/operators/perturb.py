"""Perturbations of healthy tables, one per failure class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def perturb_nulls(df: DataFrame, column: str, key: Column) -> DataFrame:
    """NULL out ``column`` where the whole-number key is even."""
    cleared = F.when(F.pmod(key, F.lit(2)) == 0, F.lit(None)).otherwise(F.col(column))
    return df.withColumn(column, cleared.cast(df.schema[column].dataType))


def perturb_nulls_hashed(df: DataFrame, column: str, key: str) -> DataFrame:
    """The same for keys of any type: about half of them, by hash."""
    return perturb_nulls(df, column, F.xxhash64(key))


def perturb_volume(df: DataFrame, key: Column, keep_one_in: int = 20) -> DataFrame:
    """Keep one row in twenty, chosen by key so that the result is the same in every run."""
    return df.filter(F.pmod(key, F.lit(keep_one_in)) == 0)


def perturb_duplicate(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Every row twice, from one scan; with ``where`` only rows it holds for, the others stay as they are."""
    copies = F.array(F.lit(0), F.lit(1))
    if where is not None:
        copies = F.when(where, copies).otherwise(F.array(F.lit(0)))
    return df.withColumn("_copy", F.explode(copies)).drop("_copy")


def perturb_schema(df: DataFrame, column: str = "category", renamed: str = "product_category_v2") -> DataFrame:
    if column in df.columns:
        return df.withColumnRenamed(column, renamed)
    return df.withColumn("unexpected_col", F.lit("drift"))


def perturb_late(df: DataFrame, hours: int = 96, lag: float = 6000.0) -> DataFrame:
    """Shift event time back and state the lag."""
    ts = next((c for c in ("event_ts", "ts") if c in df.columns), None)
    if ts is not None:
        df = df.withColumn(ts, F.col(ts) - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return df.withColumn("lag_minutes", F.lit(lag))


def truth_row(
    seed: DataFrame, failure: str, pipeline: str, run: str, table: str, detail: dict[str, object], at: Column
) -> DataFrame:
    """Ground truth of a perturbation; ``seed`` is any one-row DataFrame."""
    pairs = F.struct(*[F.lit(v).alias(k) for k, v in detail.items()])
    return seed.select(
        F.sha1(F.lit(f"{failure}:{run}")).alias("injection_id"),
        F.lit(failure).alias("failure_type"),
        F.lit(pipeline).alias("pipeline_key"),
        F.lit(run).alias("job_run_id"),
        F.lit(table).alias("target_table"),
        F.to_json(pairs).alias("detail_json"),
        at.alias("injected_at"),
    )


# Class -> perturbation of the table it is injected into; a crash changes no table.
PERTURBATIONS: dict[str, Callable[..., DataFrame] | None] = {
    "job_crash": None,
    "schema_drift": perturb_schema,
    "duplicate_explosion": perturb_duplicate,
    "null_spike": perturb_nulls_hashed,
    "volume_anomaly": perturb_volume,
    "late_data": perturb_late,
}


def perturb(failure: str, df: DataFrame, **options: object) -> DataFrame:
    if failure not in PERTURBATIONS:
        raise ValueError(f"Unknown failure_type {failure}; expected one of {tuple(PERTURBATIONS)}")
    change = PERTURBATIONS[failure]
    return df if change is None else change(df, **options)

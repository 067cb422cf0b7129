"""Data-quality checks, fused into one aggregation pass per checked table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runwarden import fixed
from runwarden.functions.decisions import compare


@dataclass(frozen=True)
class Check:
    """One check. ``kind`` names a built-in measure.

    Free SQL comes in two forms: ``expression`` is an aggregate of the table's columns (with ``FILTER`` clauses where
    it counts some rows only) and shares the scan of all other checks of that table; ``query`` is a whole statement
    that returns one row, and runs on its own.
    """

    name: str
    table: str
    metric: str
    comparator: str
    threshold: float
    kind: str = ""
    column: str = ""
    limit: float = 0.0
    predicate: str = ""
    query: str = ""
    expression: str = ""


def share(condition: Column) -> Column:
    """Share of rows meeting a condition, 0 for an empty input."""
    return F.coalesce(F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))), F.lit(0.0))


def duplicate_rate(*key: str) -> Column:
    extra = F.count("*") - F.countDistinct(*key)
    return F.coalesce(F.try_divide(extra.cast("double"), F.count("*").cast("double")), F.lit(0.0))


def measure(check: Check, told_apart: Mapping[str, Sequence[str]] | None = None) -> Column:
    if check.expression:
        return F.expr(check.expression).cast("double")
    if check.kind == "violations":
        return F.count_if(F.expr(check.predicate)).cast("double")
    if check.kind == "row_count":
        return F.count("*").cast("double")
    if check.kind == "null_count":
        return F.count_if(F.col(check.column).isNull()).cast("double")
    if check.kind == "null_rate":
        return share(F.col(check.column).isNull())
    if check.kind == "duplicate_rate":
        return duplicate_rate(*(told_apart or {}).get(check.column, (check.column,)))
    if check.kind == "share_over":
        return share(F.col(check.column) > check.limit)
    raise ValueError(f"unknown check kind: {check.kind}")


# --- fixed values: the five shipped checks ------------------------------------------
SHIPPED_CHECKS = (
    Check("orders_non_negative_amount", "demo.silver.orders", "bad_rows", "==", 0.0,
          kind="violations", predicate="amount_usd < 0"),
    Check("orders_non_null_customer", "demo.silver.orders", "null_rows", "==", 0.0,
          kind="null_count", column="customer_id"),
    Check("customers_email_null_rate", "demo.silver.customers", "null_rate", "<=", fixed.NULL_RATE_LIMIT,
          kind="null_rate", column="email"),
    Check("orders_duplicate_rate", "demo.silver.orders", "duplicate_rate", "<=", 0.01,
          kind="duplicate_rate", column="order_id"),
    Check("events_lag_under_48h", "demo.silver.events", "pct_late", "<=", 0.05,
          kind="share_over", column="lag_minutes", limit=fixed.LATE_MINUTES),
)


def _aggregated(df: DataFrame, aggs: Sequence[Column], variants: tuple[str, Sequence[object]] | None) -> DataFrame:
    """One row of aggregates, or one for each variant."""
    if variants is None:
        return df.agg(*aggs)
    column, values = variants
    found = df.groupBy(column).agg(*aggs)
    empty = df.limit(0).agg(*aggs).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(column), "*")
    both = found.withColumn("_seen", F.lit(1)).unionByName(empty.withColumn("_seen", F.lit(0)))
    return both.groupBy(column).agg(*[F.max_by(c, "_seen").alias(c) for c in found.columns if c != column])


def _long_form(observed: DataFrame, checks: Sequence[Check], carry: Sequence[str] = ()) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("check_name"),
                F.lit(c.table).alias("table_name"),
                F.lit(c.metric).alias("metric_name"),
                F.col(f"m{i}").cast("double").alias("observed_value"),
                F.lit(float(c.threshold)).alias("threshold_value"),
                F.lit(c.comparator).alias("comparator"),
            )
            for i, c in enumerate(checks)
        ]
    )
    return observed.select(*carry, F.inline(rows))


def measured(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    checks: Sequence[Check],
    told_apart: Mapping[str, Sequence[str]] | None = None,
    variants: tuple[str, Sequence[object]] | None = None,
) -> DataFrame:
    """One row per check with its outcome; all checks of a table but whole statements share one scan and aggregation.

    ``told_apart`` names, for a column that is never NULL, other such columns that differ whenever it does: duplicates are then
    counted by these, which a table may already be partitioned by. ``variants`` names a column of the tables and its values:
    each value's rows are a table of their own, all measured in one pass, and results carry the column. A value without
    rows is an empty table. Whole statements know no variants.
    """
    carry = [variants[0]] if variants else []
    if variants and any(c.query for c in checks):
        raise ValueError("whole statements know no variants")
    parts = []
    for name in dict.fromkeys(c.table for c in checks if not c.query):
        mine = [c for c in checks if c.table == name and not c.query]
        aggs = [measure(c, told_apart).alias(f"m{i}") for i, c in enumerate(mine)]
        parts.append(_long_form(_aggregated(tables[name], aggs, variants), mine, carry))
    for c in checks:
        if c.query:
            parts.append(_long_form(spark.sql(c.query).select(F.col(c.metric).alias("m0")), [c]))
    if not parts:
        raise ValueError("no checks given")
    rows = reduce(DataFrame.unionByName, parts)
    outcome = compare(F.col("observed_value"), F.col("comparator"), F.col("threshold_value"))
    return rows.withColumn("passed", outcome)


def label_runs(
    rows: DataFrame,
    runs: Sequence[tuple[str, str]] | Mapping[object, Sequence[tuple[str, str]]],
    checked_at: Column,
    variant: str | None = None,
) -> DataFrame:
    """Results under the name of every given ``(run_id, pipeline_key)``; with ``variant``, of those given for its value."""

    def names(pairs: Sequence[tuple[str, str]]) -> Column:
        return F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(p).alias("pipeline_key")) for r, p in pairs])

    if variant is None:
        named = names(runs)
    else:
        named = reduce(lambda c, kv: c.when(F.col(variant) == F.lit(kv[0]), names(kv[1])), runs.items(), F)
    return rows.select(F.inline(named), *[c for c in rows.columns if c != variant], checked_at.alias("checked_at"))


def run_checks(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    checks: Sequence[Check],
    run_id: str,
    pipeline_key: str,
    checked_at: Column,
) -> DataFrame:
    """All checks under one run; append the result to ``fact_dq_check``."""
    return label_runs(measured(spark, tables, checks), [(run_id, pipeline_key)], checked_at)


def dq_summary(results: DataFrame) -> DataFrame:
    passed = F.count_if(F.col("passed"))
    return results.agg(
        F.count("*").alias("checks_total"),
        passed.alias("checks_passed"),
        (F.count("*") - passed).alias("checks_failed"),
    )


def dup_rate(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), duplicate_rate(key).alias("duplicate_rate"))


def pct_late(events: DataFrame, limit: float = fixed.LATE_MINUTES) -> DataFrame:
    return events.agg(share(F.col("lag_minutes") > limit).alias("pct_late"))


def sample_bad_records(
    df: DataFrame, order: Sequence[str], limit: int = 5, first_columns: int | None = None
) -> DataFrame:
    """A bounded look at rows with a NULL in any column (or the first few); the limit is the feature."""
    tests = [F.col(c).isNull() for c in df.columns[:first_columns]]
    if not tests:
        return df.filter(F.lit(False))
    return df.filter(reduce(Column.__or__, tests)).orderBy(*order).limit(limit)

"""Table repairs after human approval."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden.functions import snapshots
from runwarden.operators.baselines import pipeline_name
from runwarden.operators.keyed import flag_latest
from runwarden.operators.telemetry import current_vs_history, since

RECENCY_COLUMNS = ("updated_at", "created_at", "order_ts", "event_ts")


def quarantine_nulls(df: DataFrame, column: str) -> DataFrame:
    """All rows with ``is_quarantined`` set where ``column`` is NULL; one scan, no shuffle."""
    if column not in df.columns:
        raise ValueError(f"column {column} not in table")
    return df.withColumn("is_quarantined", F.col(column).isNull())


def quarantine_duplicates(df: DataFrame, key: str) -> DataFrame:
    """All rows with ``is_quarantined`` set on every row of a key but the latest.

    Copies that are equal in every column count as duplicates too: one of them stays.
    """
    if key not in df.columns:
        raise ValueError(f"key {key} not in table")
    order = [F.col(c).desc_nulls_last() for c in RECENCY_COLUMNS if c in df.columns]
    flagged = flag_latest(df, [key], order, "_keep")
    return flagged.withColumn("is_quarantined", ~F.col("_keep")).drop("_keep")


def kept(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~F.col("is_quarantined")).drop("is_quarantined")


def quarantined(flagged: DataFrame, at: Column) -> DataFrame:
    return flagged.filter("is_quarantined").drop("is_quarantined").withColumn("quarantined_at", at)


def quarantine(df: DataFrame, parameters: Mapping[str, str]) -> DataFrame:
    """Flag rows by the strategy of an approved remediation."""
    strategy = parameters.get("strategy") or "drop_null_keys"
    if strategy == "drop_null_keys":
        return quarantine_nulls(df, parameters.get("column") or "email")
    if strategy == "keep_latest_per_key":
        return quarantine_duplicates(df, parameters.get("key") or "order_id")
    raise ValueError(f"unknown quarantine strategy: {strategy}")


def replay_window(events: DataFrame, as_of: Column, lookback_hours: int = 168, ts: str = "event_ts") -> DataFrame:
    """Rows a replay reads again: those since ``as_of`` minus the approved lookback."""
    return events.filter(since(ts, as_of, lookback_hours))


def schema_ddl(tables: DataFrame) -> DataFrame:
    """Additive statements for drifted tables.

    Takes ``(table_name, expected, current)`` with both schemas as maps. A lost column whose type matches
    a new column is taken for a rename and restored; other new columns are left to a reviewer.
    """
    c, e = F.col("current"), F.col("expected")
    parts = tables.select(
        "table_name", "current", "expected", snapshots.added(c, e).alias("new"), snapshots.removed(c, e).alias("lost")
    )

    def source_of(lost: Column) -> Column:
        same = F.filter("new", lambda n: F.element_at(c, n) == F.element_at(e, lost))
        return F.get(same, F.lit(0))

    pairs = F.transform("lost", lambda x: F.struct(x.alias("column"), source_of(x).alias("source")))
    parts = parts.select("*", pairs.alias("pairs"))
    restored = F.filter("pairs", lambda p: p["source"].isNotNull())
    table = F.col("table_name")
    add = F.transform(
        restored,
        lambda p: F.concat(
            F.lit("ALTER TABLE "),
            table,
            F.lit(" ADD COLUMN "),
            p["column"],
            F.lit(" "),
            F.upper(F.element_at(e, p["column"])),
            F.lit(" COMMENT 'restored alias for "),
            p["source"],
            F.lit("'"),
        ),
    )
    gone = F.transform(
        F.filter("pairs", lambda p: p["source"].isNull()),
        lambda p: F.concat(F.lit("-- REVIEW: "), table, F.lit(" lost column "), p["column"]),
    )
    unexplained = F.array_except(F.col("new"), F.transform(restored, lambda p: p["source"]))
    review = F.transform(
        unexplained,
        lambda n: F.concat(
            F.lit("-- REVIEW: ALTER TABLE "),
            table,
            F.lit(" DROP COLUMN "),
            n,
            F.lit(";  -- destructive, not auto-applied"),
        ),
    )
    everything = F.concat(add, gone, review)
    none = F.array(F.concat(F.lit("-- No additive DDL required for "), table))
    return parts.select(
        "table_name",
        restored.alias("renames"),
        F.when(F.size(everything) > 0, everything).otherwise(none).alias("ddl_statements"),
    )


def task_schemas(telemetry: DataFrame, as_of: Column, lookback_hours: float | None = None) -> DataFrame:
    """``(table_name, expected, current)`` of every pipeline and task: its oldest earlier snapshot and its newest run's."""
    flagged = current_vs_history(telemetry.filter(since("ended_at", as_of, lookback_hours)))
    snap = F.nullif("schema_snapshot_json", F.lit(""))
    earlier = F.when(F.try_parse_json(snap).isNotNull() & ~F.col("is_current"), F.struct("ended_at", "run_id"))
    tasks = flagged.groupBy(pipeline_name().alias("table_name"), "task_name").agg(
        snapshots.parsed(F.min_by(snap, earlier)).alias("expected"),
        snapshots.parsed(F.max(F.when(F.col("is_current"), snap))).alias("current"),
    )
    return tasks.select("table_name", "expected", "current")


def merged_ddl(tables: DataFrame) -> DataFrame:
    """One row per table with the distinct statements of all its rows in ``tables``, restoring ones first."""
    single = schema_ddl(tables).select("table_name", F.explode_outer("ddl_statements").alias("statement"))
    none = F.concat(F.lit("-- No additive DDL required for "), F.col("table_name"))
    wanted = F.when(F.col("statement") != none, F.col("statement"))
    found = single.groupBy("table_name").agg(F.array_sort(F.collect_set(wanted)).alias("found"))
    first = F.filter("found", lambda x: x.startswith("ALTER "))
    rest = F.filter("found", lambda x: ~x.startswith("ALTER "))
    statements = F.when(F.size("found") > 0, F.concat(first, rest)).otherwise(F.array(none))
    return found.select("table_name", statements.alias("ddl_statements"))


def rename_pairs(expected: Mapping[str, str], df: DataFrame) -> dict[str, str]:
    """Lost column -> new column of the same type, read from the schemas alone."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    lost = sorted(set(expected) - set(have))
    new = sorted(set(have) - set(expected))
    found = {c: next((n for n in new if have[n] == expected[c]), None) for c in lost}
    return {c: n for c, n in found.items() if n is not None}


def apply_additive(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Restore columns next to their renamed source; nothing is dropped."""
    return df.select("*", *[F.col(new).alias(old) for old, new in renames.items() if old not in df.columns])

"""Tables on shared storage: append, versioned replace, mirrors, exports."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runwarden import schemas
from runwarden.session import fresh_dir

MIRRORED = (
    "incidents",
    "incident_signals",
    "incident_status_events",
    "approvals",
    "agent_actions",
    "audit_log",
)


class TableStore:
    """Named parquet tables below a shared folder.

    ``replace`` writes a new version beside the old one and only then repoints the name, so a table can
    be rewritten from itself and a lost executor never leaves half a table behind.
    """

    def __init__(self, spark: SparkSession, label: str = "tables", catalog: str | None = None) -> None:
        self.spark, self.label, self.catalog = spark, label, catalog

    def full_name(self, name: str) -> str:
        flat = re.sub(r"[^A-Za-z0-9_]", "_", name)
        return f"{self.catalog}.{flat}" if self.catalog else flat

    def ensure_schema(self) -> None:
        if self.catalog:
            self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.catalog}")

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self.full_name(name))

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """The table, or an empty one of ``schema`` when it was never written."""
        if schema is not None and not self.exists(name):
            return schemas.empty(self.spark, schema)
        return self.spark.table(self.full_name(name))

    def replace(self, name: str, df: DataFrame) -> None:
        self.ensure_schema()
        path = fresh_dir(self.spark, f"{self.label}/{self.full_name(name)}")
        df.write.parquet(path)
        full = self.full_name(name)
        kept = self.spark.table(full).schema if self.exists(name) else None
        if kept is not None and [(f.name, f.dataType) for f in kept] == [(f.name, f.dataType) for f in df.schema]:
            # one catalog update: a reader finds the old version or the new one
            self.spark.sql(f"ALTER TABLE {full} SET LOCATION '{path}'")
            self.spark.catalog.refreshTable(full)
            return
        # only other columns need another table entry
        self.spark.sql(f"DROP TABLE IF EXISTS {full}")
        self.spark.catalog.createTable(full, path=path, source="parquet")

    def append(self, name: str, df: DataFrame, schema: T.StructType | None = None) -> None:
        rows = df if schema is None else schemas.conform(df, schema)
        if not self.exists(name):
            self.replace(name, rows)
        else:
            rows.write.mode("append").insertInto(self.full_name(name))

    def drop(self, *names: str) -> None:
        """Forget tables; their files stay for whoever still reads them."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.full_name(name)}")

    def counted_replace(self, name: str, df: DataFrame) -> int:
        """Replace and return the number of rows, counted while writing."""
        seen = Observation()
        self.replace(name, df.observe(seen, F.count(F.lit(1)).alias("n")))
        return seen.get["n"]


def mirror_sync(store: TableStore, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Refresh the analytics copies of the application tables; one result row per copy."""
    results = []
    for name in MIRRORED:
        try:
            n = store.counted_replace(f"{name}_mirror", sources[name])
            results.append((f"{name}_mirror", name, True, n, None))
        except Exception as exc:  # a broken source must not stop the other mirrors
            results.append((f"{name}_mirror", name, False, None, str(exc)))
    return store.spark.createDataFrame(
        results, "mirror string, source string, ok boolean, row_count bigint, error string"
    )


def incremental_mirror(mirror: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Mirror plus changed rows, newest version of each key."""
    from runwarden.operators.keyed import latest_per_key

    both = mirror.withColumn("_c", F.lit(0)).unionByName(changes.withColumn("_c", F.lit(1)))
    return latest_per_key(both, [key], [F.col(version).desc_nulls_last(), F.col("_c").desc()]).drop("_c")


def read_runbooks(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files of a folder as ``(runbook_path, text)``."""
    return spark.read.text(f"{folder}/*.md", wholetext=True).select(
        F.input_file_name().alias("runbook_path"), F.col("value").alias("text")
    )


def write_grades(grades: DataFrame, path: str) -> None:
    schemas.conform(grades, schemas.GRADES).write.mode("overwrite").csv(path, header=True)


def read_grades(spark: SparkSession, path: str, grader: str = "human") -> DataFrame:
    rows = spark.read.csv(path, schema=schemas.GRADES, header=True)
    return rows.select(
        "incident_id",
        F.coalesce("job_run_id", F.lit("")).alias("job_run_id"),
        "score",
        F.coalesce("grader", F.lit(grader)).alias("grader"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def write_reports(reports: DataFrame, folder: str) -> None:
    """Reports as JSON lines and as Markdown texts."""
    from runwarden.operators.evidence import rca_markdown

    reports.write.mode("overwrite").json(f"{folder}/json")
    rca_markdown(reports).write.mode("overwrite").parquet(f"{folder}/markdown")


def load_checks(path: str):
    """Checks from a YAML or JSON file with a ``checks`` list of free-SQL or built-in checks.

    YAML needs the yaml package; without it the file must be JSON.
    """
    import json

    from runwarden.operators.quality import Check

    with open(path, encoding="utf-8") as fh:
        body = fh.read()
    try:
        import yaml

        data = yaml.safe_load(body)
    except ImportError:
        data = json.loads(body)
    listed = data.get("checks", []) if isinstance(data, dict) else []
    if not listed:
        raise ValueError(f"No checks found in {path}")
    return [
        Check(
            name=c["name"],
            table=c["table"],
            metric=c["metric_field"],
            comparator=c["comparator"],
            threshold=float(c["threshold"]),
            kind=c.get("kind", ""),
            column=c.get("column", ""),
            limit=float(c.get("limit", 0.0)),
            predicate=c.get("predicate", ""),
            query=c.get("query", ""),
            expression=c.get("expression", ""),
        )
        for c in listed
    ]

"""Keyed tables with versions: merge of changed rows, reading as of a time, updates that can't lose each other.

A version is a small table (its manifest) with one row per bucket of keys, naming the folder that holds the bucket.
Committing a version is creating the catalog table ``<name>__v<number>``: the catalog creates a name once, so of two
writers one wins and the other sees the conflict. A merge rewrites only the buckets its keys fall into; if another
writer changed none of these in the meantime, the finished files are committed on top, else the change is made again
from the newer version. Readers take the folders of one version and never see half a change.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runwarden.operators.keyed import latest_per_key
from runwarden.session import fresh_dir, staged

ROWS_PER_BUCKET = 1_000_000
MOST_BUCKETS = 1 << 14  # bounds a manifest; beyond, buckets grow instead
_BUCKET = "_bucket"
_MANIFEST = "version long, committed_at timestamp, buckets int, columns string, bucket int, folder string, n_rows long"


class Conflict(RuntimeError):
    """Another writer kept committing first."""


@dataclass(frozen=True)
class Version:
    """``folders``: bucket to (folder, rows). Its size is bounded by the number of buckets."""

    number: int
    committed_at: datetime
    buckets: int
    schema: T.StructType
    folders: dict[int, tuple[str, int]]

    @property
    def n_rows(self) -> int:
        return sum(n for _, n in self.folders.values())


class VersionedTable:
    """A table of unique ``key``, of which ``order`` (a version or time column) says which row is newer."""

    def __init__(self, spark: SparkSession, name: str, key: Sequence[str], order: str) -> None:
        if not re.fullmatch(r"\w+(\.\w+)?", name):
            raise ValueError(f"not a table name: {name}")
        self.spark, self.name, self.key, self.order = spark, name, list(key), order

    # -- versions -----------------------------------------------------------------------
    def numbers(self) -> list[int]:
        """Version numbers, oldest first."""
        database, _, table = self.name.rpartition(".")
        where = f" IN {database}" if database else ""
        listed = self.spark.sql(f"SHOW TABLES{where} LIKE '{table.lower()}__v*'").collect()
        found = [re.fullmatch(rf"{re.escape(table.lower())}__v(\d+)", r["tableName"]) for r in listed]
        return sorted(int(m[1]) for m in found if m)

    def version(self, number: int | None = None) -> Version:
        if number is None:
            numbers = self.numbers()
            if not numbers:
                raise LookupError(f"no version of {self.name}")
            number = numbers[-1]
        rows = self.spark.table(f"{self.name}__v{number:09d}").collect()
        one = rows[0]
        folders = {r["bucket"]: (r["folder"], r["n_rows"]) for r in rows if r["bucket"] is not None}
        return Version(number, one["committed_at"], one["buckets"], T.StructType.fromJson(json.loads(one["columns"])), folders)

    def as_of(self, at: datetime) -> Version | None:
        """The newest version committed up to ``at``, or None."""
        for number in reversed(self.numbers()):
            found = self.version(number)
            if found.committed_at <= at:
                return found
        return None

    def _commit(self, made: Version) -> bool:
        """Whether ``made`` became the version of its number; False when another writer holds that number."""
        rows = [(b, folder, n) for b, (folder, n) in sorted(made.folders.items())] or [(None, None, None)]
        path = fresh_dir(self.spark, f"versions/{self.name}/manifest")
        listed = self.spark.createDataFrame(rows, "bucket int, folder string, n_rows long")
        listed.select(
            F.lit(made.number).cast("long").alias("version"),
            F.lit(made.committed_at).cast("timestamp").alias("committed_at"),
            F.lit(made.buckets).alias("buckets"),
            F.lit(made.schema.json()).alias("columns"),
            "bucket",
            "folder",
            "n_rows",
        ).coalesce(1).write.parquet(path)
        schema = T.StructType.fromDDL(_MANIFEST)
        try:
            self.spark.catalog.createTable(f"{self.name}__v{made.number:09d}", path=path, source="parquet", schema=schema)
        except AnalysisException as exc:
            if exc.getCondition() == "TABLE_OR_VIEW_ALREADY_EXISTS":
                return False
            raise
        return True

    # -- reading ------------------------------------------------------------------------
    def read(self, at: datetime | None = None, version: Version | None = None) -> DataFrame:
        """The newest rows, those as of ``at`` (none before the first version), or those of ``version``."""
        if version is None:
            version = self.version() if at is None else self.as_of(at)
        if version is None:
            return self.spark.createDataFrame([], self.version(self.numbers()[0]).schema)
        return self._rows(version, list(version.folders))

    def _rows(self, version: Version, buckets: Sequence[int]) -> DataFrame:
        folders = [version.folders[b][0] for b in buckets if b in version.folders]
        if not folders:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*folders)

    # -- writing ------------------------------------------------------------------------
    def _bucketed(self, df: DataFrame, buckets: int) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int"))

    def _written(self, df: DataFrame) -> dict[int, tuple[str, int]]:
        """Writes rows that carry their bucket; folder and rows of every bucket."""
        path = fresh_dir(self.spark, f"versions/{self.name}/rows")
        df.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(path)
        counts = self.spark.read.schema(df.schema).parquet(path).groupBy(_BUCKET).count().collect()
        return {r[0]: (f"{path}/{_BUCKET}={r[0]}", r[1]) for r in counts}

    def _newest(self, df: DataFrame) -> DataFrame:
        return latest_per_key(df, self.key, [F.col(self.order).desc_nulls_last(), F.col("_change").desc()])

    def replace(self, df: DataFrame, at: datetime, buckets: int | None = None) -> Version:
        """All rows anew, also with other columns; the first call creates the table. Old versions stay readable."""
        rows = staged(self._newest(df.withColumn("_change", F.lit(0))).drop("_change"), f"versions/{self.name}/new")
        buckets = buckets or min(MOST_BUCKETS, max(1, -(-rows.count() // ROWS_PER_BUCKET)))
        folders = self._written(self._bucketed(rows, buckets))
        while True:
            numbers = self.numbers()
            made = Version((numbers[-1] if numbers else 0) + 1, at, buckets, rows.schema, folders)
            if self._commit(made):
                return made

    def update(self, change: Callable[[DataFrame], DataFrame], at: datetime, attempts: int = 20) -> Version:
        """Commits what ``change`` makes of the newest rows: rows to insert or to put in place of those of their key.

        Rows whose ``order`` is older than the stored row's change nothing. ``change`` is called again when another
        writer has meanwhile committed a change to the same buckets.
        """
        base, done = self.version(), None
        for _ in range(attempts):
            if done is None:
                fresh = change(self.read(version=base)).select(*base.schema.names).withColumn("_change", F.lit(1))
                fresh = staged(self._bucketed(self._newest(fresh), base.buckets), f"versions/{self.name}/changes")
                touched = [r[0] for r in fresh.select(_BUCKET).distinct().collect()]
                if not touched:
                    return base
                old = self._bucketed(self._rows(base, touched).withColumn("_change", F.lit(0)), base.buckets)
                done = self._written(self._newest(old.unionByName(fresh)).drop("_change"))
            others = {b: f for b, f in base.folders.items() if b not in touched}
            made = Version(base.number + 1, max(at, base.committed_at), base.buckets, base.schema, others | done)
            if self._commit(made):
                return made
            newest = self.version()
            moved = newest.buckets != base.buckets or newest.schema != base.schema
            if moved or any(newest.folders.get(b) != base.folders.get(b) for b in touched):
                done = None
            base = newest
        raise Conflict(f"{self.name}: {attempts} attempts")

    def merge(self, changes: DataFrame, at: datetime) -> Version:
        return self.update(lambda _: changes, at)

    def forget(self, keep: int) -> None:
        """Drops the entries of all but the newest ``keep`` versions; files stay for whoever still reads them."""
        for number in self.numbers()[: -max(keep, 1)]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}__v{number:09d}")

    def drop(self) -> None:
        """Drops all entries. What was read before stays readable."""
        for number in self.numbers():
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}__v{number:09d}")

    # -- what versions are for --------------------------------------------------------------
    def compare(self, at: datetime, earlier: datetime, table_name: str | None = None) -> DataFrame:
        """One row: numbers of rows as of both times, and of rows added, changed and removed in between.

        Buckets that both versions share are skipped; the rest meets by key.
        """
        new, old = self.as_of(at), self.as_of(earlier)
        folders = [v.folders if v else {} for v in (new, old)]
        differ = [b for b in {*folders[0], *folders[1]} if folders[0].get(b) != folders[1].get(b)]
        resized = new is not None and old is not None and new.buckets != old.buckets

        def side(version: Version | None, name: str) -> DataFrame:
            if version is None:
                rows = self.spark.createDataFrame([], self.version(self.numbers()[0]).schema)
            else:
                rows = self._rows(version, list(version.folders) if resized else differ)
            values = [F.col(c) for c in rows.columns if c not in self.key]
            # as bytes a digest is half as long, and it moves with every row
            return rows.select(*self.key, F.unhex(F.sha2(F.to_json(F.struct(*values)), 256)).alias(name))

        now, before = side(new, "_now"), side(old, "_before")
        both = now.join(before, self.key, "full_outer")
        return both.agg(
            F.lit(table_name or self.name).alias("table_name"),
            F.lit(new.n_rows if new else 0).cast("long").alias("current_count"),
            F.lit(old.n_rows if old else None).cast("long").alias("earlier_count"),
            F.count_if(F.col("_before").isNull() & F.col("_now").isNotNull()).alias("n_added"),
            F.count_if(F.col("_now") != F.col("_before")).alias("n_changed"),
            F.count_if(F.col("_now").isNull() & F.col("_before").isNotNull()).alias("n_removed"),
        )

    def history(self) -> DataFrame:
        """(version, committed_at, n_rows, n_buckets) of all versions."""
        parts = [self.spark.table(f"{self.name}__v{n:09d}") for n in self.numbers()]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.groupBy("version", "committed_at").agg(
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.count("bucket").alias("n_buckets")
        )


def claim(table: VersionedTable, by: str, at: datetime, limit: int, lease_minutes: int = 30) -> Version:
    """Claims the oldest open incidents for one investigator: ``agent_started_at`` and ``claimed_by`` are written.

    Open are incidents of status OPEN that nobody has claimed, or whose claim has run out. The limit is the
    feature: a batch of work. Two claimers never hold the same incident, since the second to commit chooses again.
    """

    def chosen(rows: DataFrame) -> DataFrame:
        lapsed = F.lit(at).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lease_minutes))
        free = F.col("agent_started_at").isNull() | (F.col("agent_started_at") <= lapsed)
        picked = rows.where((F.col("status") == "OPEN") & free).orderBy("detected_at", *table.key).limit(limit)
        return picked.withColumns(
            {
                "agent_started_at": F.lit(at).cast("timestamp"),
                "claimed_by": F.lit(by),
                table.order: F.greatest(table.order, F.lit(at).cast("timestamp")),
            }
        )

    return table.update(chosen, at)

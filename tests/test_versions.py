"""Versioned tables: merges, reading as of a time, and writers that meet each other."""

import threading
import uuid
from datetime import datetime, timedelta

import pytest
from helpers import plan_of
from pyspark.sql import functions as F

from runwarden.sources.versions import Conflict, VersionedTable, claim

T0 = datetime(2024, 1, 1)


def hour(n):
    return T0 + timedelta(hours=n)


@pytest.fixture
def table(spark):
    return VersionedTable(spark, f"versioned_{uuid.uuid4().hex}", ["id"], "updated_at")


def rows(spark, *values):
    return spark.createDataFrame([(i, v, hour(h)) for i, v, h in values], "id long, value string, updated_at timestamp")


def content(df):
    return {r["id"]: r["value"] for r in df.collect()}


def test_merge_inserts_replaces_and_keeps_newer(spark, table):
    table.replace(rows(spark, *[(i, "old", 1) for i in range(50)], (7, "older", 0)), hour(1), buckets=8)
    before = table.version()
    made = table.merge(rows(spark, (3, "new", 2), (3, "newest", 3), (4, "stale", 0), (99, "added", 2)), hour(3))
    want = {i: "old" for i in range(50)} | {3: "newest", 99: "added"}
    assert content(table.read()) == want and made.n_rows == 51
    kept = [b for b in before.folders if made.folders[b] == before.folders[b]]
    assert len(kept) >= 5  # only buckets of the changed keys are rewritten
    assert content(table.read(hour(2))) == {i: "old" for i in range(50)}
    assert table.read(hour(0)).count() == 0
    assert table.merge(rows(spark), hour(4)).number == made.number
    diff = table.compare(hour(3), hour(1)).collect()[0]
    assert tuple(diff)[1:] == (51, 50, 1, 1, 0)


def test_other_columns_leave_no_gap(spark, table):
    table.replace(rows(spark, (1, "a", 1)), hour(1))
    table.replace(rows(spark, (1, "a", 1)).withColumn("more", F.lit(2)), hour(2))
    assert table.read().columns == ["id", "value", "updated_at", "more"]
    assert table.read(hour(1)).columns == ["id", "value", "updated_at"]
    assert [r["n_rows"] for r in table.history().orderBy("version").collect()] == [1, 1]
    table.forget(1)
    assert table.numbers() == [2] and table.read().count() == 1


def test_null_keys_and_empty_tables(spark, table):
    table.replace(rows(spark), hour(1), buckets=3)
    assert table.read().count() == 0
    table.merge(rows(spark, (None, "n", 1), (1, "a", 1)), hour(2))
    table.merge(rows(spark, (None, "m", 2)), hour(3))
    assert content(table.read()) == {None: "m", 1: "a"}


def test_two_writers_lose_no_rows(spark, table):
    table.replace(rows(spark, *[(i, "old", 0) for i in range(40)]), hour(0), buckets=4)
    both, errors, calls = threading.Barrier(2), [], []

    def write(name, ids):
        first = []

        def change(_):
            calls.append(name)
            if not first:
                first.append(1)
                both.wait(60)  # both start from the same version
            return rows(spark, *[(i, name, 1) for i in ids])

        try:
            table.update(change, hour(1))
        except Exception as exc:
            errors.append(exc)

    threads = [threading.Thread(target=write, args=a) for a in (("a", range(0, 20)), ("b", range(20, 40)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and content(table.read()) == {i: "a" if i < 20 else "b" for i in range(40)}
    assert len(calls) == 3  # the one that came second made its change again


def test_disjoint_buckets_are_committed_on_top(spark, table):
    table.replace(rows(spark, *[(i, "old", 0) for i in range(64)]), hour(0), buckets=16)
    calls = []

    def change(_):
        calls.append(1)
        if len(calls) == 1:
            table.merge(rows(spark, (1, "other", 1)), hour(1))
        return rows(spark, (mine, "mine", 1))

    bucket = dict(table._bucketed(spark.range(64), 16).select("id", "_bucket").collect())
    mine = next(i for i in range(64) if bucket[i] != bucket[1])
    table.update(change, hour(1))
    found = content(table.read())
    assert (found[1], found[mine], len(calls)) == ("other", "mine", 1)


def test_endless_conflict_is_told(spark, table):
    table.replace(rows(spark, (1, "a", 0)), hour(0))

    def change(_):
        table.merge(rows(spark, (1, "other", 1)), hour(1))
        return rows(spark, (1, "mine", 1))

    with pytest.raises(Conflict):
        table.update(change, hour(1), attempts=2)


def incident_rows(spark, n):
    out = [(f"i{k:03d}", hour(k), "OPEN" if k % 3 else "RESOLVED", None, None, hour(k)) for k in range(n)]
    return spark.createDataFrame(
        out, "incident_id string, detected_at timestamp, status string, agent_started_at timestamp, claimed_by string, updated_at timestamp"
    )


def test_claimers_never_share_an_incident(spark):
    table = VersionedTable(spark, f"claims_{uuid.uuid4().hex}", ["incident_id"], "updated_at")
    table.replace(incident_rows(spark, 45), hour(45), buckets=2)
    start, errors = threading.Barrier(3), []

    def work(name):
        try:
            start.wait(60)
            claim(table, name, hour(50), 7)
        except Exception as exc:
            errors.append(exc)

    threads = [threading.Thread(target=work, args=(f"agent-{k}",)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    held = table.read().where("claimed_by is not null").orderBy("detected_at").collect()
    per_agent = {a: sum(r["claimed_by"] == a for r in held) for a in {r["claimed_by"] for r in held}}
    assert per_agent == {f"agent-{k}": 7 for k in range(3)} and all(r["agent_started_at"] == hour(50) for r in held)
    oldest = [f"i{k:03d}" for k in range(45) if k % 3][:21]
    assert sorted(r["incident_id"] for r in held) == oldest  # the oldest open ones, each once

    claim(table, "late", hour(51), 100)  # a lease of half an hour has run out
    assert table.read().where("claimed_by = 'late'").count() == 30
    assert claim(table, "none", hour(51), 100).number == table.version().number


def test_digests_of_a_comparison_move_as_bytes(spark, table):
    table.replace(rows(spark, (1, "a", 1), (2, "b", 1)), hour(1), buckets=2)
    table.merge(rows(spark, (2, "c", 2), (3, "d", 2)), hour(2))
    compared = table.compare(hour(2), hour(1))
    assert "unhex(sha2(" in plan_of(compared)
    assert tuple(compared.first())[1:] == (3, 2, 1, 1, 0)

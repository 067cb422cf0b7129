import json
from datetime import datetime, timedelta

import pytest
from helpers import NOW, as_of, plan_of, run
from pyspark.sql import functions as F

from runwarden import schemas
from runwarden.operators import analytics, logs, medallion, perturb, quality, remediation, rules, telemetry
from runwarden.operators.keyed import flag_latest, latest_per_key
from runwarden.plans import catalog
from runwarden.sources import storage
from runwarden.streaming import jobs


def orders(spark, n=40):
    rows = [(f"o{i % 30}", f"c{i % 7}", f"p{i % 5}", i, NOW - timedelta(hours=i), "PLACED", float(i)) for i in range(n)]
    cols = "order_id string, customer_id string, product_id string, quantity int, order_ts timestamp, status string, amount_usd double"
    return spark.createDataFrame(rows, cols).repartition(3)


def test_latest_per_key_limits_groups_before_the_shuffle(spark):
    df = latest_per_key(orders(spark), ["order_id"], [F.col("order_ts").desc()])
    assert df.count() == 30
    plan = plan_of(df)
    assert plan.count("WindowGroupLimit") >= 2


def test_flag_latest_keeps_exactly_one_of_identical_copies(spark):
    hot = spark.range(0, 3000, 1, 6).select(F.lit("hot").alias("k"), (F.col("id") % 3).alias("v"))
    cold = spark.range(50).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(0).cast("long").alias("v"))
    df = hot.unionByName(cold)
    got = flag_latest(df, ["k"], [F.col("v").desc()])
    assert got.count() == 3050
    kept = {r.k: r.v for r in got.filter("is_latest").collect()}
    assert len(kept) == 51 and kept["hot"] == 2
    # both branches must read the same partition numbers
    whole = flag_latest(df, ["k"], [F.col("v").desc()])
    whole.collect()
    assert "ReusedExchange" in plan_of(whole)


def test_double_then_quarantine_restores_the_table(spark):
    silver = medallion.silver_orders(orders(spark))
    flagged = remediation.quarantine(perturb.perturb("duplicate_explosion", silver), {"strategy": "keep_latest_per_key"})
    assert sorted(remediation.kept(flagged).collect()) == sorted(silver.collect())
    assert remediation.quarantined(flagged, as_of()).count() == silver.count()


def test_null_quarantine_moves_exactly_the_nulls(spark):
    holed = perturb.perturb("null_spike", orders(spark), column="customer_id", key="order_id")
    nulls = holed.filter("customer_id IS NULL").count()
    flagged = remediation.quarantine(holed, {"column": "customer_id"})
    assert 0 < nulls == remediation.quarantined(flagged, as_of()).count()
    assert remediation.kept(flagged).filter("customer_id IS NULL").count() == 0
    with pytest.raises(ValueError):
        remediation.quarantine_nulls(holed, "nope")
    with pytest.raises(ValueError):
        remediation.quarantine(holed, {"strategy": "nope"})


def test_renamed_column_is_proposed_and_restored(spark):
    cols = "product_id string, category string, price_usd double"
    df = spark.createDataFrame([("1", "home", 2.0)], cols)
    drifted = perturb.perturb_schema(df)
    expected = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pairs = remediation.rename_pairs({"category": "string", "product_id": "string", "price_usd": "double"}, drifted)
    assert pairs == {"category": "product_category_v2"}
    assert remediation.apply_additive(drifted, pairs).collect()[0].category == "home"
    current = {f.name: f.dataType.simpleString() for f in drifted.schema.fields}
    extra = {**expected, "unexpected_col": "string"}
    maps = spark.createDataFrame(
        [("t", expected, current), ("u", expected, extra), ("v", expected, expected)],
        "table_name string, expected map<string,string>, current map<string,string>",
    )
    ddl = {r.table_name: r.ddl_statements for r in remediation.schema_ddl(maps).collect()}
    assert ddl["t"] == ["ALTER TABLE t ADD COLUMN category STRING COMMENT 'restored alias for product_category_v2'"]
    assert ddl["u"][0].startswith("-- REVIEW: ALTER TABLE u DROP COLUMN unexpected_col")
    assert ddl["v"] == ["-- No additive DDL required for v"]


def test_ddl_of_all_tasks_of_a_pipeline(spark, monkeypatch):
    a = {"id": "int", "kind": "string"}
    renamed, lost, more, other = {"id": "int", "kind_v2": "string"}, {"id": "int"}, {**a, "extra": "date"}, {"x": "int"}
    pairs = [("p", "t1", a, a), ("p", "t2", a, renamed), ("p", "t3", a, lost), ("p", "t4", a, more), ("p", "t5", other, other)]
    pairs += [("p", "t6", a, renamed), ("q", "t1", a, a), ("q", "t2", None, a), ("r", "t1", None, None)]
    rows = []
    for i, (pipeline, task, *both) in enumerate(pairs):
        for day, columns in enumerate(both):
            rows.append((f"{i}-{day}", pipeline, task, NOW - timedelta(days=2 - day), columns and json.dumps(columns)))

    class Given:
        telemetry = spark.createDataFrame(
            rows, "run_id string, pipeline_key string, task_name string, ended_at timestamp, schema_snapshot_json string"
        ).selectExpr("*", "'SUCCESS' status", "1L rows_out", "1L duration_ms", "'' metadata_json")
        as_of = as_of()

        def scored(self):
            return rules.scored_runs(self.telemetry, as_of(), None)

    monkeypatch.setattr(catalog, "Tables", lambda *_: Given())
    found = {r.table_name: r.ddl_text.split("\n") for r in catalog.queries()["schema_ddl"](spark, "").collect()}
    assert found == {
        "p": [
            "ALTER TABLE p ADD COLUMN kind STRING COMMENT 'restored alias for kind_v2'",
            "-- REVIEW: ALTER TABLE p DROP COLUMN extra;  -- destructive, not auto-applied",
            "-- REVIEW: p lost column kind",
        ],
        "q": ["-- No additive DDL required for q"],
        "r": ["-- No additive DDL required for r"],
    }


def test_commits_since_the_true_last_success(spark, monkeypatch):
    at = [datetime(2024, 1, day) for day in (1, 5, 20, 25)]

    class Given:
        telemetry = spark.createDataFrame(
            [("p", "SUCCESS", at[0]), ("p", "SUCCESS", at[2]), ("p", "FAILED", at[3])],
            "pipeline_key string, status string, ended_at timestamp",
        )
        commits = spark.createDataFrame(
            [("old", "m", "a", at[1], ["src/demo/x.py"]), ("new", "m", "a", at[3], ["src/demo/x.py"])],
            "sha string, message string, author string, committed_at timestamp, files array<string>",
        )

    monkeypatch.setattr(catalog, "Tables", lambda *_: Given())
    assert [r.sha for r in catalog.queries()["commits_since_success"](spark, "").collect()] == ["new"]


def test_checks_fuse_into_one_scan_per_table(spark):
    df = orders(spark)
    checks = [c for c in quality.SHIPPED_CHECKS if c.table == "demo.silver.orders"]
    got = quality.run_checks(spark, {"demo.silver.orders": df}, checks, "r", "p", as_of())
    rows = {r.check_name: r for r in got.collect()}
    assert rows["orders_duplicate_rate"].observed_value == 0.25 and rows["orders_duplicate_rate"].passed is False
    assert rows["orders_non_null_customer"].passed
    assert quality.dq_summary(got).collect()[0] == (3, 2, 1)
    empty = quality.run_checks(spark, {"demo.silver.orders": df.limit(0)}, checks, "r", "p", as_of())
    assert all(r.observed_value == 0.0 for r in empty.collect())
    df.createOrReplaceTempView("o_view")
    free = [quality.Check("mine", "o_view", "n", ">", 10.0, query="SELECT count(*) AS n FROM o_view")]
    assert quality.run_checks(spark, {}, free, "r", "p", as_of()).collect()[0].passed


def test_payload_rows(spark):
    payload = """{"runs":[{"run_id":1,"job_id":9,"run_name":"nightly","tasks":[
      {"run_id":11,"task_key":"a","state":{"life_cycle_state":"TERMINATED","result_state":"FAILED","state_message":"x OutOfMemoryError y"}},
      {"run_id":12,"task_key":"b","state":{"life_cycle_state":"TERMINATED","result_state":"SUCCESS"}}]},
      {"run_id":2,"job_id":8,"tasks":[{"state":{"life_cycle_state":"INTERNAL_ERROR"}}]}, {"run_id":3}]}"""
    df = spark.createDataFrame([(payload,), ("{oops",)], "payload string")
    got = sorted(logs.task_log_explode(df, "payload", as_of()).collect())
    assert [(r.run_id, r.task_run_id, r.pipeline_key, r.task_key, r.result_state, r.error_signature) for r in got] == [
        ("1", "11", "nightly", "a", "FAILED", "OutOfMemoryError"),
        ("2", "2", "job_8", "unknown_task", None, "unknown_failure"),
    ]


def test_fetched_outputs_are_merged(spark):
    df = spark.createDataFrame([("t1", "bang", "x"), ("t2", "", "x"), ("t3", "msg", "x")], "task_run_id string, raw_output string, error_signature string")
    out = spark.createDataFrame(
        [("t1", " ValueError: a ", " ok ", None, None), ("t2", "", " done", None, None), ("t3", None, None, 500, "Traceback")],
        "task_run_id string, error string, result string, http_status int, http_body string",
    )
    got = {r.task_run_id: (r.raw_output, r.error_signature) for r in logs.with_outputs(df, out).collect()}
    assert got["t1"] == ("bang\nValueError: a\nok", "Error")
    assert got["t2"] == ("done", "unknown_failure")
    assert got["t3"] == ("msg\nget-output failed: 500 Traceback", "Traceback")


def test_scd2_versions(spark):
    cols = "customer_id string, email string, full_name string, country string, created_at timestamp, updated_at timestamp"
    first = spark.createDataFrame([("a", "e", "n", "X", NOW, NOW), ("b", None, "n", "X", NOW, NOW)], cols)
    later = NOW + timedelta(days=1)
    second = spark.createDataFrame(
        [("a", "e", "n", "Y", NOW, later), ("b", None, "n", "X", NOW, later), ("c", "e", "n", "X", NOW, later)], cols
    )
    got = medallion.scd2_apply(medallion.dim_customer(first), second).collect()
    shown = sorted((r.customer_id, r.country, r.is_current, r.effective_to) for r in got)
    assert shown == [("a", "X", False, later), ("a", "Y", True, None), ("b", "X", True, None), ("c", "X", True, None)]
    again = medallion.scd2_apply(medallion.scd2_apply(medallion.dim_customer(first), second), second)
    assert again.count() == 4


def test_scd2_ignores_late_snapshots(spark):
    cols = "customer_id string, email string, full_name string, country string, created_at timestamp, updated_at timestamp"
    first = spark.createDataFrame([("a", "e", "n", "X", NOW, NOW)], cols)
    moved = spark.createDataFrame([("a", "e", "n", "Y", NOW, NOW + timedelta(days=2))], cols)
    late = spark.createDataFrame([("a", "e", "n", "Z", NOW, NOW + timedelta(days=1))], cols)
    dim = medallion.scd2_apply(medallion.dim_customer(first), moved)
    got = medallion.scd2_apply(dim, late).collect()
    assert sorted((r.country, r.is_current) for r in got) == [("X", False), ("Y", True)]
    assert all(r.effective_to is None or r.effective_to > r.effective_from for r in got)


@pytest.mark.parametrize(("hours", "kept"), [(0.25, 0), (0.5, 1), (1.5, 2), (2.5, 3)])
def test_lookback_takes_parts_of_an_hour(spark, hours, kept):
    rows = run(spark, *[{"run_id": f"r{i}", "ago": i - 0.6} for i in range(1, 4)])
    assert rows.filter(telemetry.since("ended_at", as_of(), hours)).count() == kept


def test_bad_records_look_at_every_column(spark):
    names = [f"c{i}" for i in range(10)]
    rows = spark.createDataFrame([(*range(9), None), tuple(range(10))], ", ".join(f"{n} int" for n in names))
    assert quality.sample_bad_records(rows, ["c0"]).count() == 1
    assert quality.sample_bad_records(rows, ["c0"], first_columns=8).count() == 0


def test_detection_stream_goes_on_after_a_restart(spark, tmp_path):
    columns = "payload string, collected_at timestamp"
    source, sink, state = f"{tmp_path}/in", f"{tmp_path}/sink", f"{tmp_path}/state"

    def arrive(run_id):
        payload = (
            f'{{"runs":[{{"run_id":{run_id},"job_id":1,"run_name":"orders_ingest","tasks":[{{"run_id":{run_id}0,"task_key":"load",'
            '"state":{"life_cycle_state":"TERMINATED","result_state":"FAILED","state_message":"boom"}}]}]}'
        )
        spark.createDataFrame([(payload, NOW)], columns).coalesce(1).write.mode("append").json(source)

    def go():
        rows = logs.task_log_explode(jobs.payload_stream(spark, source), "payload", F.col("collected_at"))
        jobs.detect_stream(rows, sink, state).awaitTermination()
        return sorted(r.job_run_id for r in jobs.streamed_incidents(spark, sink).collect())

    arrive(1)
    assert go() == ["1"]
    arrive(2)
    arrive(1)
    assert go() == ["1", "2"]
    assert go() == ["1", "2"]


def test_slow_runs_match_brute_force(spark):
    rows = [{"run_id": f"r{i}", "ago": 24 * (20 - i) + 1, "duration_ms": d} for i, d in enumerate([10, 12, 30, 9, 50, 11, 8, 10, 70, 9])]
    got = {r.run_id for r in telemetry.slow_runs(run(spark, *rows)).collect()}
    days = {r["run_id"]: (NOW - timedelta(hours=r["ago"])).date() for r in rows}
    want = set()
    for r in rows:
        past = sorted(x["duration_ms"] for x in rows if 1 <= (days[r["run_id"]] - days[x["run_id"]]).days <= 7)
        if past:
            n = len(past)
            median = past[n // 2] if n % 2 else (past[n // 2 - 1] + past[n // 2]) / 2
            if r["duration_ms"] > 2 * median:
                want.add(r["run_id"])
    assert got == want and want


def test_store_rewrites_a_table_from_itself(spark):
    store = storage.TableStore(spark, "t")
    name = f"rw_{datetime.now().strftime('%H%M%S%f')}"
    store.replace(name, spark.range(10).toDF("x"))
    held = store.read(name)
    store.replace(name, store.read(name).filter("x > 4"))
    assert store.read(name).count() == 5
    assert held.count() == 10  # whoever reads the old version still can
    store.append(name, spark.range(3).toDF("x"))
    assert store.counted_replace(name, store.read(name)) == 8
    store.drop(name)
    assert not store.exists(name)
    assert store.read(name, schemas.GRADES).count() == 0


def test_incremental_mirror_takes_newest(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(2, 2, "B"), (3, 1, "c")], "k int, v int, x string")
    assert sorted(r.x for r in storage.incremental_mirror(old, new, "k", "v").collect()) == ["B", "a", "c"]


def test_mttr(spark):
    at = [NOW, NOW + timedelta(minutes=30)]
    ev = spark.createDataFrame(
        [("i", None, "OPEN", at[0]), ("i", "OPEN", "RESOLVED", at[1]), ("j", None, "OPEN", at[0])],
        "incident_id string, from_status string, to_status string, changed_at timestamp",
    )
    assert analytics.mttr_minutes(ev).collect()[0] == (30.0, 1)


def test_recorder_records_success_and_failure(spark):
    seen = []
    rec = telemetry.TelemetryRecorder(spark, seen.append)
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    rec.run("r1", "p", "t", lambda raw: raw.limit(40), sink, "customer_id", {"raw": orders(spark)})
    with pytest.raises(ZeroDivisionError):
        rec.run("r2", "p", "t", lambda: 1 / 0, sink)
    ok, bad = seen[0].collect()[0], seen[1].collect()[0]
    assert ok.status == "SUCCESS" and ok.rows_out == 40 and "order_id" in ok.schema_snapshot_json
    assert bad.status == "FAILED" and bad.error_class == "ZeroDivisionError" and "1 / 0" in bad.stacktrace


def test_free_expressions_share_one_scan(spark):
    spark.range(100).selectExpr("id", "id % 3 = 0 AS third").createOrReplaceTempView("free_view")
    sql = ("count(*) FILTER (WHERE third)", "avg(id)", "count(DISTINCT id % 7)", "percentile(id, 0.5)", "max(id) - min(id)")
    checks = [quality.Check(f"c{i}", "t", "m", ">", 7.0, expression=e) for i, e in enumerate(sql)]
    found = quality.measured(spark, {"t": spark.table("free_view")}, checks)
    assert [r.observed_value for r in found.orderBy("check_name").collect()] == [34.0, 49.5, 7.0, 49.5, 99.0]
    assert [r.passed for r in found.orderBy("check_name").collect()] == [True, True, False, True, True]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1


def test_checks_are_loaded_from_a_file(spark, tmp_path):
    listed = [
        {"name": "a", "table": "t", "metric_field": "m", "comparator": "<=", "threshold": 3, "expression": "count(*)"},
        {"name": "b", "table": "t", "metric_field": "m", "comparator": "==", "threshold": 0, "kind": "null_count", "column": "x"},
    ]
    path = tmp_path / "checks.yml"
    path.write_text(json.dumps({"checks": listed}))  # JSON is YAML too
    checks = storage.load_checks(str(path))
    rows = quality.measured(spark, {"t": spark.createDataFrame([(1,), (None,)], "x int")}, checks)
    assert {r.check_name: (r.observed_value, r.passed) for r in rows.collect()} == {"a": (2.0, True), "b": (1.0, False)}
    path.write_text("{}")
    with pytest.raises(ValueError, match="No checks"):
        storage.load_checks(str(path))


def test_reports_are_written_as_json_and_markdown(spark, tmp_path):
    columns = ("incident_id", "summary", "root_cause", "root_cause_type", "blast_radius", "suspected_commit_sha", "remediation_proposal", "cited_runbook")
    reports = spark.createDataFrame([tuple(f"{c}!" for c in columns)], ", ".join(f"{c} string" for c in columns))
    storage.write_reports(reports.withColumn("evidence", F.array(F.lit("one"), F.lit("two"))), str(tmp_path))
    row = spark.read.json(f"{tmp_path}/json").collect()[0]
    assert row.summary == "summary!" and row.evidence == ["one", "two"]
    text = spark.read.parquet(f"{tmp_path}/markdown").collect()[0].markdown
    assert text.startswith("# RCA") and "- one\n- two" in text and "root_cause!" in text


def test_rows_behind_the_watermark_go_to_their_own_table(spark, tmp_path):
    source, state = f"{tmp_path}/in", f"{tmp_path}/state"
    schema = "event_id long, ts timestamp"
    sink = jobs.TelemetrySink(spark, f"{tmp_path}/sink", "p", "ts", 60)

    def arrive(*hours):
        rows = [(i, None if h is None else NOW + timedelta(hours=h)) for i, h in enumerate(hours)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        again = jobs.TelemetrySink(spark, f"{tmp_path}/sink", "p", "ts", 60)  # a new process
        jobs.watched(spark.readStream.schema(schema).parquet(source), again, state).awaitTermination()

    arrive(0, 5)
    arrive(6, 4.5, 3.5, None)
    arrive(4.9, 5.1)
    about = sink.about().orderBy("batch").collect()
    assert [(r.rows_in, r.rows_out, r.late_rows) for r in about] == [(2, 2, 0), (4, 3, 1), (2, 1, 1)]
    assert about[2].watermark == NOW + timedelta(hours=5)
    late = sink.rows(spark.createDataFrame([], schema).schema, late=True)
    assert sorted(r.ts for r in late.collect()) == [NOW + timedelta(hours=3.5), NOW + timedelta(hours=4.9)]

"""Running values, exact quantiles and packed minima, with keys that own most rows, against plain Python."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from helpers import plan_of
from pyspark.sql import functions as F

from runwarden.functions import decisions
from runwarden.operators import baselines, evidence, incidents, logs, perturb, quality, scan, scoring, telemetry
from runwarden.operators.keyed import first_rows, order_number
from runwarden.operators.quantiles import exact_quantiles
from runwarden.plans import catalog
from runwarden.sources.tables import Tables

NOW = datetime(2024, 2, 1)


@pytest.fixture
def ranges(spark):
    """Small ranges that stay apart, so that a key of a few hundred rows crosses many borders."""
    settings = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def chain_rows():
    pick = random.Random(4)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 else pick.choice(["a", "b", None])
        at = 0 if i % 2 else pick.choice([None, *range(20)])
        rows.append((key, at, i, pick.choice([None, None, "x", "y", "z"]), pick.choice([None, 1, 5])))
    pick.shuffle(rows)
    return rows


def plain_running(rows):
    out, state = {}, {}
    for key, at, i, value, n in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        total, last = state.get(key, (0, None))
        out[i] = (total, last)
        state[key] = total + (n or 0), value if value is not None else last
    return out


def test_running_values_of_a_hot_key(spark, ranges):
    rows = chain_rows()
    df = spark.createDataFrame(rows, "key string, at long, i long, value string, n long")
    placed = scan.dealt(df, ["key"], ["at", "i"])
    hot = placed.where("key = 'hot' and at = 0").select("_segment").distinct().count()
    assert hot > 3  # even one instant of one key lies in several ranges
    found = scan.running(df, ["key"], ["at", "i"], totals={"total": F.col("n")}, lasts={"last": F.col("value")})
    assert found.columns == [*df.columns, "total", "last"]
    assert {r["i"]: (r["total"], r["last"]) for r in found.collect()} == plain_running(rows)
    assert found.count() == len(rows)


def test_status_chain_of_one_incident_in_one_hour(spark, ranges):
    pick = random.Random(8)
    asked = [(f"r{i:04d}", "hot", pick.choice(["OPEN", "RESOLVED"]), NOW + timedelta(seconds=i % 7), "me") for i in range(500)]
    asked += [("q1", "other", "OPEN", NOW, "me"), ("q2", "nobody", "OPEN", NOW, "me")]
    requests = spark.createDataFrame(asked, "request_id string, incident_id string, to_status string, changed_at timestamp, changed_by string")
    status = spark.createDataFrame([("hot", "OPEN"), ("other", "OPEN")], "incident_id string, status string")
    found = {(r["incident_id"], r["event_id"]): (r["from_status"], r["to_status"], r["outcome"]) for r in incidents.apply_status_changes(status, requests).collect()}
    now, want = {"hot": "OPEN", "other": "OPEN"}, []
    for _, who, to, _, _ in sorted(asked, key=lambda r: (r[1], r[3], r[0])):
        before = now.get(who)
        want.append((before, to, "incident not found" if before is None else "noop" if before == to else "applied"))
        if before is not None:
            now[who] = to
    assert sorted(map(str, found.values())) == sorted(map(str, want))


@pytest.mark.parametrize("spread", [3, 1000, 10**12])
def test_quantiles_equal_percentile(spark, spread):
    pick = random.Random(spread)
    rows = [("hot", pick.randrange(-spread, spread), pick.randrange(1, 5)) for _ in range(2000)]
    rows += [(k, pick.randrange(spread), 1) for k in "abc" for _ in range(pick.randrange(1, 6))]
    rows += [("one", 7, 1), (("none"), None, 3), ("same", 5, 4), ("same", 5, 2)]
    df = spark.createDataFrame(rows, "key string, v long, n long")
    at = (0.0, 0.25, 0.5, 0.9, 1.0)
    want = df.where("v is not null").groupBy("key").agg(F.percentile("v", F.array(*[F.lit(p) for p in at]), F.col("n")).alias("q"))
    found = exact_quantiles(df, ["key"], "v", at, "n")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plain = exact_quantiles(df, ["key"], "v", (0.5,))
    assert sorted(map(tuple, plain.collect())) == sorted(
        map(tuple, df.where("v is not null").groupBy("key").agg(F.array(F.percentile("v", F.lit(0.5)))).collect())
    )
    assert exact_quantiles(df.limit(0), ["key"], "v", at).count() == 0


def test_quantile_plans_hold_no_values(spark):
    for name in ("slow_runs", "volume_iqr"):
        assert "percentile" not in plan_of(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    assert telemetry.exact_quantiles is baselines.exact_quantiles is exact_quantiles


def test_first_rows_take_the_least_number(spark):
    pick = random.Random(2)
    rows = [(pick.choice("ab"), pick.randrange(3), pick.randrange(100), f"p{i}") for i in range(300)]
    rows += rows[:20]  # repeated rows count once
    df = spark.createDataFrame(rows, "key string, a int, b int, payload string")
    number = order_number((F.col("a"), 1), (F.col("b"), 3))
    found = first_rows(df, ["key"], number, ("a", "b", "payload"), ("payload",))
    for r in found.collect():
        best = min((x[1], x[2]) for x in rows if x[0] == r["key"])
        assert (r["a"], r["b"]) == best
        assert r["payload"] == min(x[3] for x in rows if x[0] == r["key"] and (x[1], x[2]) == best)
    assert found.count() == 2


@pytest.mark.parametrize("name", ["incidents", "incident_upsert", "detect_volume"])
def test_minima_are_hashed_not_sorted(spark, name):
    assert "SortAggregate" not in plan_of(catalog.queries()[name](spark, "/root/testdata/sf0.001"))


def test_rows_of_a_chain_and_first_rows_move_once(spark):
    requests = spark.range(50).selectExpr(
        "cast(id as string) request_id", "cast(id % 7 as string) incident_id", "'OPEN' to_status",
        "timestamp_seconds(id) changed_at", "'me' changed_by",
    )
    status = requests.groupBy("incident_id").agg(F.lit("OPEN").alias("status"))
    # the rows are dealt when the plan is built; only what one range leaves to the next is shuffled after that
    assert plan_of(incidents.apply_status_changes(status, requests)).count("hashpartitioning(incident_id") == 1
    first = first_rows(requests, ["incident_id"], order_number((F.lit(1), 1)), ("changed_by",), ("request_id",))
    assert plan_of(first).count("hashpartitioning") <= 2


@pytest.mark.parametrize("size", [1, 3, 40, 1000])
def test_running_values_go_on_over_batches(size):
    rows = sorted(((r[0] or "", r[1] or 0, r[2], r[3], r[4]) for r in chain_rows()), key=lambda r: r[:3])
    table = pa.table([list(c) for c in zip(*rows, strict=True)], names=["key", "at", "i", "value", "n"])
    batches = iter(table.to_batches(max_chunksize=size))
    out = scan._before_each(batches, ["key"], {"total": "n"}, {"last": "value"}, {"total": pa.int64()})
    got = {r["i"]: (r["total"], r["last"]) for b in out for r in b.to_pylist()}
    assert got == plain_running(rows)


def test_check_results_are_handed_over_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    reports = plan_of(catalog._reports(t))
    # reports and signals read the same small table of results instead of checking all orders again
    assert "dq_results" in t._staged and "l_extendedprice" not in reports


def test_order_ids_are_made_behind_the_shuffle(spark):
    plan = plan_of(Tables(spark, "/root/testdata/sf0.001").silver_orders)
    assert plan.index("concat_ws") < plan.index("hashpartitioning(l_orderkey") and plan.count("concat_ws") == 1


def test_lines_move_once_for_the_checks_on_orders(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for a broadcast
    try:
        plan = plan_of(Tables(spark, "/root/testdata/sf0.001").dq_results)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # no shuffle by line for the removal of copies, nor by id to count distinct ones, healthy or doubled
    assert "hashpartitioning(l_orderkey" in plan
    assert not any(
        "l_linenumber#" in part.split(")")[0] or "order_id#" in part.split(")")[0] for part in plan.split("hashpartitioning(")[1:]
    )


def test_duplicates_are_counted_by_other_columns_that_tell_the_same(spark):
    rows = [(1, 1, "1-1"), (1, 1, "1-1"), (1, 2, "1-2"), (2, 1, "2-1")]
    df = spark.createDataFrame(rows, "a int, b int, id string")
    check = quality.Check("c", "t", "duplicate_rate", "<=", 0.01, kind="duplicate_rate", column="id")
    plain, apart = (quality.measured(spark, {"t": df}, [check], told) for told in (None, {"id": ("a", "b")}))
    assert plain.collect() == apart.collect() and apart.first().observed_value == 0.25
    assert "keys=[id#" not in plan_of(apart)


def test_a_line_without_number_is_an_order_of_its_own(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    lines = Tables(spark, folder).table("lineitem").limit(200).localCheckpoint()
    lines = lines.withColumn("l_linenumber", F.when(F.col("l_linenumber") != 1, F.col("l_linenumber")))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("orders", "customer", "nation", "events"):
        Tables(spark, folder).table(name).write.parquet(f"{tmp_path}/{name}.parquet")
    t = Tables(spark, str(tmp_path))
    assert t.silver_orders.where("order_id not like '%-%'").count() > 0
    checks = t.dq_results.where("check_name = 'orders_duplicate_rate'").select("run_id", "observed_value").collect()
    assert {r.observed_value for r in checks if r.run_id == "dq-healthy"} == {0.0}
    assert {r.observed_value for r in checks if r.run_id == "prove-duplicate_explosion"} == {0.5}


def test_only_the_asked_parts_of_a_proposal_move(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = plan_of(incidents.latest_proposal(t.run_proposals, "job_run_id").select("job_run_id", "remediation_type"))
    assert "detail_json" not in plan[: plan.index("hashpartitioning(job_run_id")]


def test_made_columns_give_the_same_running_values_and_do_not_move(spark, ranges):
    rows = chain_rows()
    df = spark.createDataFrame(rows, "k string, t long, i long, v string, n long")
    made = {"key": F.col("k"), "at": F.col("t") + 0, "value": F.concat("v", F.lit(""))}
    found = scan.running(df, ["key"], ["at", "i"], totals={"total": F.col("n")}, lasts={"last": F.col("value")}, made=made)
    assert found.columns == [*df.columns, *made, "total", "last"]
    assert {r["i"]: (r["total"], r["last"]) for r in found.collect()} == plain_running(rows)
    placed = scan.dealt(df, ["key"], ["at", "i"], lambda ranged: ranged.drop(*made), made)
    assert set(placed.columns) == {*df.columns, "_at", "_segment"}


def test_copies_of_one_row_still_lie_in_several_ranges(spark, ranges):
    df = spark.range(3000).selectExpr("'hot' key", "0 at")
    assert scan.dealt(df, ["key"], ["at"]).select("_segment").distinct().count() > 3


def test_requests_and_decisions_move_as_numbers(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    texts = {"request_id", "decision_id", "changed_by", "decided_by", "decision", "job_run_id"}
    assert not texts & set(t.asked_lines.columns)
    written = []
    placed = scan.staged

    def kept(df, label):
        written.append((label, df.columns))
        return placed(df, label)

    scan.staged = kept
    try:
        t.decided.count()
    finally:
        scan.staged = placed
    assert len(written) == 2  # one deal for the requests, one for the decisions
    assert not texts & {c for _, columns in written for c in columns}


def test_plain_and_made_requests_agree(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    opened = t.at("incidents").select("job_run_id", "status")
    plain = t.asked_lines.select(*[c.alias(n) for n, c in t.status_requests.items()])
    one, two = (
        sorted(map(tuple, df.select("incident_id", "from_status", "to_status", "changed_at", "changed_by", "outcome").collect()), key=str)
        for df in (t.status_changes, incidents.apply_status_changes(opened, plain, "job_run_id"))
    )
    assert one == two and len(one) == t.asked_lines.count()


def test_timeline_by_run_is_sorted_and_equals_that_by_incident(spark):
    pick = random.Random(6)
    at = [NOW + timedelta(minutes=m) for m in range(9)]
    runs = [pick.choice(["hot", "hot", "a", "b", "c"]) for _ in range(400)]
    rows = spark.createDataFrame([(r, pick.choice(at), pick.choice("xyz")) for r in runs], "job_run_id string, t timestamp, what string")
    rows = rows.withColumn("incident_id", incidents.incident_id(F.col("job_run_id")))
    parts = (
        rows.selectExpr("*", "t detected_at", "what failure_type"),
        rows.selectExpr("*", "t changed_at", "what from_status", "what to_status"),
        rows.selectExpr("*", "t created_at", "what tool_name"),
        rows.selectExpr("*", "t decided_at", "what decision"),
    )
    by_run = incidents.incident_timeline(*parts, "job_run_id")
    found = [tuple(r) for r in by_run.select("incident_id", "at", "kind", "detail").collect()]
    assert found == sorted(found) and len(found) == 1600
    assert found == [tuple(r) for r in incidents.incident_timeline(*parts).select("incident_id", "at", "kind", "detail").collect()]
    # the id stands above the shuffle and in its ranges, but is not among the columns that move
    assert "rangepartitioning(sha1(" in plan_of(by_run)


def test_ids_of_incidents_are_made_behind_stage_and_joins(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    held = t.at("incidents")
    assert "incident_id" not in spark.read.parquet(*held.inputFiles()).columns
    assert held.columns == t.incidents.columns
    assert sorted(held.collect(), key=str) == sorted(t.incidents.collect(), key=str)


def test_reports_from_repeated_signals_and_rows_without_ids_are_the_same(spark):
    t = Tables(spark, "/root/testdata/sf0.001")

    def reports(opened, signals):
        nothing = t.truth.limit(0)
        return evidence.rca_report(
            opened,
            signals,
            t.at("dq_results"),
            t.task_logs,
            t.telemetry,
            evidence.correlate_commits(opened.select("pipeline_key"), t.commits),
            nothing.selectExpr("job_run_id query_id", "failure_type runbook_path", "1 rank"),
            t.spark.createDataFrame([("demo.silver.customers", "seen")], "table_name string, sampled string"),
        ).drop("history_sample")

    by_id = reports(t.at("incidents"), t.incident_signals)
    by_run = reports(t.at("incidents").drop("incident_id"), t.at("signals").unionByName(t.at("signals")))
    found = by_run.select(by_id.columns).collect()
    assert sorted(found, key=str) == sorted(by_id.collect(), key=str)
    assert any("sampled_bad_records=seen" in r["evidence"] for r in found)


def test_variants_of_a_table_are_measured_in_one_pass(spark):
    rows = [(1, "1-1", 5.0, False), (1, "1-1", -5.0, True), (2, "2-1", 1.0, True), (2, "2-1", 1.0, True), (3, None, 1.0, False)]
    df = spark.createDataFrame(rows, "a int, id string, amount double, twice boolean")
    checks = [
        quality.Check("copies", "t", "r", "<=", 0.01, kind="duplicate_rate", column="id"),
        quality.Check("negative", "t", "n", "==", 0.0, kind="violations", predicate="amount < 0"),
    ]
    names = {False: [("healthy", "p"), ("other", "q")], True: [("doubled", "p")]}

    def found(df):
        both = quality.measured(spark, {"t": df}, checks, variants=("twice", (False, True)))
        return sorted(quality.label_runs(both, names, F.lit(NOW), "twice").collect(), key=str)

    def alone(df):
        parts = [quality.label_runs(quality.measured(spark, {"t": df.where(F.col("twice") == v)}, checks), n, F.lit(NOW)) for v, n in names.items()]
        return sorted(parts[0].unionByName(parts[1]).collect(), key=str)

    for some in (df, df.where("twice"), df.limit(0)):
        assert found(some) == alone(some) and len(found(some)) == 6


def test_copies_of_orders_are_removed_once_for_all_checks(spark):
    plan = plan_of(Tables(spark, "/root/testdata/sf0.001").dq_results)
    assert len([w for w in plan.split("Window [row_number()")[1:] if "l_orderkey" in w.split("]")[1]]) == 1


def test_only_some_rows_are_doubled(spark):
    df = spark.range(4).withColumn("twice", F.expr("if(id < 2, id = 0, null)"))
    assert sorted(r.id for r in perturb.perturb_duplicate(df, F.col("twice")).collect()) == [0, 0, 1, 2, 3]


def test_classes_and_tables_of_signals(spark):
    pick = random.Random(8)
    shown = [None, "{}", "no json table_name", '{"table_name":"x"}', '{"t\\u0061ble_name":"y"}', '{"a":"table_name"}']
    classes = ["job_crash", "late_data", "null_spike", "own", "aaa", None]
    rows = [(f"r{i % 90}", pick.choice(classes), pick.choice("wp"), pick.choice(shown), pick.randrange(3)) for i in range(200)]
    df = spark.createDataFrame(rows, "job_run_id string, failure_type string, detected_by string, evidence_json string, rule_rank int")
    found = evidence._signalled(df, "job_run_id")
    named = F.get_json_object("evidence_json", "$.table_name")
    first = F.struct(decisions.class_priority(F.col("failure_type")), "rule_rank", "detected_by", "evidence_json")
    want = df.groupBy("job_run_id").agg(
        F.array_sort(F.collect_set("failure_type")).alias("classes"),
        F.min_by(named, F.when(named.isNotNull(), first)).alias("table_name"),
    )
    assert sorted(found.collect()[0:], key=str) == sorted(want.collect(), key=str)
    assert {r.table_name for r in found.collect()} == {None, "x", "y"}
    assert "HashAggregate(keys=[job_run_id" in plan_of(found) and "bit_or" in plan_of(found)


def test_a_question_of_most_incidents_is_dealt_to_several_tasks(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for a broadcast
    try:
        plan = plan_of(catalog._reports(Tables(spark, "/root/testdata/sf0.001")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [part.split(")")[0] for part in plan.split("hashpartitioning(failure")[1:]]
    assert dealt and sum("_part" in part for part in dealt) == 2


def test_listings_without_runs_or_tasks_have_no_failed_task(spark):
    payloads = spark.createDataFrame(
        [('{"runs":null}',), ('{"runs":[]}',), ('{"runs":[{"run_id":1,"tasks":[]},{"run_id":2}]}',), ("no json",), (None,),
         ('{"runs":[{"run_id":3,"tasks":[{"state":{"result_state":"FAILED"}},{"state":null},{}]}]}',)], "payload string"
    )
    found = logs.task_log_explode(payloads, "payload", F.lit(NOW))
    assert [r.run_id for r in found.collect()] == ["3"]
    # listings are not built a second time to test whether they are empty
    assert "size(" not in plan_of(Tables(spark, "/root/testdata/sf0.001").task_logs)


def test_evidence_does_not_move_with_grades(spark):
    reports = spark.range(100).selectExpr(
        "cast(id as string) incident_id", "cast(id as string) job_run_id", "'a' root_cause_type",
        "transform(sequence(1, 1 + id % 3), x -> cast(x as string)) evidence",
    )
    truth = spark.range(100).selectExpr("cast(id as string) job_run_id", "if(id % 2 = 0, 'a', 'b') failure_type")
    grades = scoring.rca_grades(reports, truth)
    assert "evidence" not in [c for c in grades.columns] and grades.where("score = 2").count() == 33
    assert "AS _lines" in plan_of(grades)
    opened = truth.selectExpr("job_run_id", "job_run_id incident_id", "failure_type primary_failure_type")
    by_run = scoring.agent_accuracy(grades, opened, "job_run_id")
    assert sorted(by_run.collect()) == sorted(scoring.agent_accuracy(grades, opened).collect())


def test_all_mirrors_read_the_incidents_that_were_handed_over(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(catalog.storage, "mirror_sync", lambda store, sources: sources)
    copies = catalog.mirror_sync(t)
    held = set(t.at("incidents").inputFiles())
    # neither copy opens incidents from signals again
    assert set(copies["incidents"].inputFiles()) == held and set(copies["audit_log"].inputFiles()) == held
    assert copies["incidents"].columns == t.incidents.columns

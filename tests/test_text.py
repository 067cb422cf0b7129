import random

import pyarrow as pa
import pytest
from helpers import NOW, as_of, embed
from pyspark.sql import functions as F

from runwarden.functions import text
from runwarden.operators import evidence, retrieval, scoring
from runwarden.sources import storage


def texts(n=60):
    rnd = random.Random(3)
    words = ["null", "spike", "orders", "schema", "drift", "late", "ünder", "job_crash", "x1", "OOM", "rows"]
    return ["", "!!!"] + [" ".join(rnd.choices(words, k=rnd.randint(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("dim", [256, 64, 1000])
def test_hashed_vectors_match_brute_force(spark, dim):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, t string")
    got = {r.i: r.v for r in df.select("i", text.dense(text.hashed_weights(F.col("t"), dim), dim).alias("v")).collect()}
    for i, t in enumerate(texts()):
        assert got[i] == pytest.approx(embed(t, dim))


def corpus(spark):
    classes = ["null_spike", "schema_drift", None]
    rows = [(f"c{i:03d}", f"books/{i}.md", classes[i % 3], f"T{i}", t) for i, t in enumerate(texts(100))]
    chunks = spark.createDataFrame(rows, "chunk_id string, runbook_path string, failure_type string, title string, chunk_text string")
    return rows, retrieval.embed_chunks(chunks.repartition(4), as_of())


def brute(rows, query, failure, k):
    q = embed(query)
    scored = []
    for cid, _, cls, _, body in rows:
        if failure is None or cls in (None, failure):
            v = embed(body)
            score = round(sum(a * b for a, b in zip(q, v)), 9) + 0.0
            scored.append((-(failure is not None and cls == failure), -score, cid))
    return [c for _, _, c in sorted(scored)[:k]]


QUERIES = [
    ("a", "null spike on orders", "null_spike"), ("b", "schema drift", "schema_drift"), ("c", "late rows", None),
    ("d", "!!", "null_spike"), ("e", "nothing shared zzz", "late_data"),
]


@pytest.mark.parametrize("rows_per_block", [8192, 2])
def test_search_matches_brute_force_in_one_and_many_blocks(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", rows_per_block)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", rows_per_block)
    rows, embedded = corpus(spark)
    asked = spark.createDataFrame(QUERIES, "query_id string, query_text string, failure_type string")
    got = retrieval.runbook_search(embedded, asked, 4).orderBy("query_id", "rank").collect()
    for qid, body, failure in QUERIES:
        assert [r.chunk_id for r in got if r.query_id == qid] == brute(rows, body, failure, 4), qid


def test_search_takes_null_ragged_and_tied_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0, 0.0, 5.0]), (4, [0.0, 1.0]), (5, [2.0, 0.0]), (6, []), (7, [None, 1.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    asked = spark.createDataFrame([("q", [0.0, 0.0, 0.0, 1.0])], "query_id string, v array<double>")
    got = retrieval.nearest(corpus, retrieval.vector_queries(asked, "v"), "vec_id", "vector", 7).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 1, 2, 4, 5, 6, 7] and [r.score for r in got[1:]] == [0.0] * 6


def test_search_answers_very_many_queries(spark):
    corpus = spark.range(40).selectExpr("id AS vec_id", "array(1.0D, cast(id as double)) AS vector")
    asked = spark.range(5000).selectExpr("id AS query_id", "array(1.0D, cast(id % 40 as double)) AS v")
    got = retrieval.nearest(corpus, retrieval.vector_queries(asked, "v"), "vec_id", "vector", 1).collect()
    assert len(got) == 5000 and all(r.vec_id == r.query_id % 40 for r in got)


def test_chunks_of_markdown(spark, tmp_path):
    (tmp_path / "null_spike.md").write_text("# Null spike\nintro\n## One\n" + "x" * 1000 + "\n## Two\n  \n## \n")
    (tmp_path / "general_notes.md").write_text("\n\n## Only\nbody")
    whole = {r.chunk_id: r.chunk_text for r in retrieval.chunk_documents(storage.read_runbooks(spark, str(tmp_path))).collect()}
    assert whole["null_spike-1"] + whole["null_spike-1-1"] == "## One\n" + "x" * 1000 and len(whole) == 5
    got = retrieval.chunk_documents(storage.read_runbooks(spark, str(tmp_path)), cut=True).collect()
    by = {r.chunk_id: r for r in got}
    assert set(by) == {"null_spike-0", "null_spike-1", "null_spike-2", "general_notes-0"}
    assert len(by["null_spike-1"].chunk_text) == 900 and by["null_spike-1"].chunk_text.endswith("...")
    assert by["null_spike-0"].failure_type == "null_spike" and by["general_notes-0"].failure_type is None
    assert by["general_notes-0"].title == "General Notes"


def test_stable_ids_and_signatures(spark):
    import hashlib

    row = spark.range(1).select(
        text.surrogate_id(42, "cust", 7).alias("i"),
        text.error_signature(F.lit("ERROR: x")).alias("s"),
        text.error_signature(F.lit("fine")).alias("n"),
        text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"),
    ).collect()[0]
    assert row.i == hashlib.sha1(b"42:cust:7").hexdigest()[:12]
    assert (row.s, row.n, row.z) == ("ERROR", "unknown_failure", 0.0)


def test_grades(spark, tmp_path):
    reports = spark.createDataFrame(
        [("1", "a", "null_spike", ["x", "y"]), ("2", "b", "null_spike", ["x"]), ("3", "c", "late_data", ["x"]), ("4", "d", "late_data", [])],
        "incident_id string, job_run_id string, root_cause_type string, evidence array<string>",
    )
    truth = spark.createDataFrame([("a", "null_spike"), ("b", "null_spike"), ("c", "null_spike")], "job_run_id string, failure_type string")
    grades = scoring.rca_grades(reports, truth)
    got = {r.job_run_id: (r.score, r.notes) for r in grades.collect()}
    assert got["a"] == (2, "type match + evidence") and got["b"] == (1, "type match, thin evidence")
    assert got["c"] == (0, "expected null_spike, got late_data") and got["d"] == (0, "missing expected failure type")
    storage.write_grades(grades, str(tmp_path / "g"))
    assert sorted(storage.read_grades(spark, str(tmp_path / "g")).select("score").collect()) == [(0,), (0,), (1,), (2,)]
    many = spark.createDataFrame([(2,)] * 17 + [(0,)], "score int")
    s = scoring.grade_summary(many).collect()[0]
    assert (s.n, s.zeros, s.exit_criteria_met) == (18, 1, True)
    assert scoring.grade_summary(many.limit(0)).collect()[0][:3] == (0, 0.0, 0)


def test_commits_by_path_hint(spark):
    commits = spark.createDataFrame(
        [("a" * 40, "m\nbody", "me", NOW, ["src/ops/x.py"]), ("b" * 40, "n", "me", NOW, ["docs/x"]), ("c" * 40, "o", "me", NOW, ["src/demo/y.py"])],
        "sha string, message string, author string, committed_at timestamp, files array<string>",
    )
    pipes = spark.createDataFrame([("ops_force_fail",), ("orders_ingest",), ("other",)], "pipeline_key string")
    got = evidence.correlate_commits(pipes, commits, 1).collect()
    assert {r.pipeline_key: r.sha for r in got} == {"ops_force_fail": "a" * 12, "orders_ingest": "c" * 12, "other": "a" * 12}


def test_review_words(spark):
    df = spark.createDataFrame(
        [("1", 5, "Great, fast delivery"), ("2", 1, "broken and bad"), ("3", 3, "fine")], "review_id string, rating int, review_text string"
    )
    got = {r.review_id: (r.sentiment, r.topic) for r in retrieval.reviews_enriched(df).collect()}
    assert got == {"1": ("positive", "shipping"), "2": ("negative", "quality"), "3": ("neutral", "other")}


def test_a_copy_of_the_corpus_serves_many_queries(monkeypatch):
    pick = random.Random(5)
    mine = pa.table(
        {
            "id": [f"c{i:02d}" for i in range(40)],
            "_class": pa.array([pick.choice([None, "a", "b"]) for _ in range(40)], pa.string()),
            "_v": pa.array([None if i == 7 else [pick.choice([0.0, 1.0, 2.0]) for _ in range(4)] for i in range(40)], pa.list_(pa.float64())),
        }
    )
    asked = pa.table(
        {
            "query_id": [f"q{i}" for i in range(11)],
            "_class": pa.array([pick.choice([None, "a", "b"]) for _ in range(11)], pa.string()),
            "terms": [[{"key": pick.randrange(4), "value": 1.0}] for _ in range(11)],
        }
    )
    assert retrieval.QUERY_BLOCK >= 16 * retrieval.QUERIES_AT_ONCE
    whole = retrieval._block_best(mine, asked, "id", (), 3, pa.string())
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 2)
    assert retrieval._block_best(mine, asked, "id", (), 3, pa.string()).to_pylist() == whole.to_pylist()
    assert whole.num_rows == 33


def test_queries_of_equal_vectors_are_scored_once(monkeypatch):
    mine = pa.table(
        {
            "id": [f"c{i}" for i in range(9)],
            "_class": pa.array([None, "a", "b"] * 3, pa.string()),
            "_v": pa.array([[float(i % 4), 1.0] for i in range(9)], pa.list_(pa.float64())),
        }
    )
    terms = [[{"key": 0, "value": 1.0}], [{"key": 1, "value": 1.0}], []]
    asked = [{"query_id": f"q{i:02d}", "_class": "ab"[i // 3 % 2], "terms": terms[i % 3]} for i in range(60)]

    def best(queries):
        table = pa.Table.from_pylist(queries) if queries else pa.Table.from_pylist(asked).slice(0, 0)
        return retrieval._block_best(mine, table, "id", (), 2, pa.string()).to_pylist()

    alone = [row for query in asked for row in best([query])]
    scored, sort = [], retrieval.np.lexsort
    monkeypatch.setattr(retrieval.np, "lexsort", lambda keys: scored.append(1) or sort(keys))
    assert best(asked) == alone and len(alone) == 120
    assert len(scored) == 6
    assert best([]) == []

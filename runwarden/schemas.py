"""Declared schemas of every operations and application-state table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "s": T.StringType(),
    "i": T.IntegerType(),
    "l": T.LongType(),
    "d": T.DoubleType(),
    "b": T.BooleanType(),
    "t": T.TimestampType(),
}


def _schema(spec: str) -> T.StructType:
    """``name:type`` words; a trailing ``!`` marks a column that is never NULL."""
    fields = []
    for word in spec.split():
        name, kind = word.split(":")
        fields.append(T.StructField(name, _TYPES[kind[0]], not kind.endswith("!")))
    return T.StructType(fields)


TASK_TELEMETRY = _schema(
    "run_id:s! pipeline_key:s! task_name:s! started_at:t! ended_at:t! duration_ms:l! status:s! "
    "rows_in:l rows_out:l schema_snapshot_json:s error_class:s error_message:s stacktrace:s metadata_json:s"
)
RAW_TASK_LOGS = _schema(
    "run_id:s! task_run_id:s! job_id:s! pipeline_key:s! task_key:s! lifecycle_state:s result_state:s "
    "error_signature:s raw_output:s collected_at:t!"
)
FACT_DQ_CHECK = _schema(
    "run_id:s pipeline_key:s check_name:s table_name:s metric_name:s observed_value:d threshold_value:d "
    "comparator:s passed:b checked_at:t"
)
INJECTED_FAILURES = _schema(
    "injection_id:s failure_type:s pipeline_key:s job_run_id:s target_table:s detail_json:s injected_at:t"
)
REMEDIATION_RUNS = _schema("incident_id:s! remediation_type:s! result_json:s! ran_at:t!")
SCHEMA_PROPOSALS = _schema("incident_id:s table_name:s ddl_text:s created_at:t")
INCIDENTS = _schema(
    "incident_id:s job_run_id:s detected_at:t pipeline_key:s primary_failure_type:s severity:s status:s "
    "agent_started_at:t rca_report_path:s linked_commit_sha:s"
)
INCIDENT_SIGNALS = _schema(
    "signal_id:s incident_id:s failure_type:s detected_by:s detected_at:t evidence_json:s"
)
STATUS_EVENTS = _schema("event_id:s incident_id:s from_status:s to_status:s changed_at:t changed_by:s")
APPROVALS = _schema(
    "approval_id:s incident_id:s decision:s decided_by:s decided_at:t remediation_type:s notes:s"
)
AGENT_ACTIONS = _schema(
    "action_id:s incident_id:s tool_name:s inputs_json:s outputs_summary:s created_at:t"
)
AUDIT_LOG = _schema(
    "audit_id:s actor:s action:s entity_type:s entity_id:s detail_json:s created_at:t"
)
SIGNALS = _schema(
    "job_run_id:s pipeline_key:s failure_type:s detected_by:s severity:s evidence_json:s detected_at:t rule_rank:i"
)
GRADES = _schema("incident_id:s job_run_id:s score:i grader:s notes:s")

# The given tables. Timestamps carry no zone and are read as UTC instants.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

RUNBOOK_EMBEDDINGS = T.StructType(
    [
        *_schema("chunk_id:s runbook_path:s failure_type:s title:s chunk_text:s").fields,
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        *_schema("embedding_backend:s embedded_at:t").fields,
    ]
)

RUNS_PAYLOAD = T.StructType(
    [
        T.StructField(
            "runs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("run_id", T.LongType()),
                        T.StructField("job_id", T.LongType()),
                        T.StructField("run_name", T.StringType()),
                        T.StructField(
                            "tasks",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("run_id", T.LongType()),
                                        T.StructField("task_key", T.StringType()),
                                        T.StructField(
                                            "state",
                                            _schema("life_cycle_state:s result_state:s state_message:s"),
                                        ),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``; columns it lacks become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)

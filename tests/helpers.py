"""Small fixtures and plain-Python statements of the rules, used as brute-force references."""

from __future__ import annotations

import hashlib
import re
from datetime import datetime, timedelta
from statistics import mean, pstdev

from pyspark.sql import functions as F

from runwarden import schemas

NOW = datetime(2024, 1, 31)
AS_OF = F.lit


def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def run(spark, *rows):
    """Telemetry rows from partial dicts; ``ago`` is hours before NOW."""
    out = []
    for r in rows:
        r = dict(r)
        at = NOW - timedelta(hours=r.pop("ago", 1))
        base = dict.fromkeys(schemas.TASK_TELEMETRY.names)
        base.update(
            run_id="r", pipeline_key="p", task_name="load", started_at=at, ended_at=at, duration_ms=1000, status="SUCCESS",
            metadata_json="{}",
        )
        base.update(r)
        out.append(base)
    return spark.createDataFrame(out, schemas.TASK_TELEMETRY)


def log(spark, *rows):
    out = []
    for r in rows:
        base = dict.fromkeys(schemas.RAW_TASK_LOGS.names)
        base.update(run_id="r", task_run_id="t", job_id="j", pipeline_key="p", task_key="k", collected_at=NOW - timedelta(hours=1))
        base.update(r)
        out.append(base)
    return spark.createDataFrame(out, schemas.RAW_TASK_LOGS)


def dq(spark, *rows):
    out = []
    for r in rows:
        base = dict.fromkeys(schemas.FACT_DQ_CHECK.names)
        base.update(run_id="r", pipeline_key="p", table_name="t", observed_value=1.0, threshold_value=0.0, comparator="<=", passed=False, checked_at=NOW - timedelta(hours=1))
        base.update(r)
        out.append(base)
    return spark.createDataFrame(out, schemas.FACT_DQ_CHECK)


def volume_hit(observed, history):
    if not history:
        return False
    if len(history) < 7:
        last = history[-1]
        return observed > 0 if last <= 0 else not 0.5 <= observed / last <= 2.0
    return abs(observed - mean(history)) / (pstdev(history) or 1e-9) >= 3.0


def null_hit(observed, history):
    if len(history) < 7:
        return observed > 0.2
    return (observed - mean(history)) / (pstdev(history) or 1e-9) >= 3.0


def duration_hit(observed, history):
    if not history:
        return False
    if len(history) < 7:
        return history[-1] > 0 and observed / history[-1] > 3.0
    return (observed - mean(history)) / (pstdev(history) or 1e-9) >= 3.0


def embed(text, dim=256):
    """Brute-force hashed vector."""
    vec = [0.0] * dim
    for token in re.findall("[a-z0-9_]+", text.lower()):
        d = hashlib.sha256(token.encode()).digest()
        vec[int.from_bytes(d[:4], "little") % dim] += -1.0 if d[4] % 2 else 1.0
    size = sum(v * v for v in vec) ** 0.5
    return [v / size for v in vec] if size else vec


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()

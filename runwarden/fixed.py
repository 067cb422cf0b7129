"""Enumerations, thresholds and lookup tables that results depend on."""

from __future__ import annotations

# --- fixed values: enumerations -------------------------------------------------
PIPELINES = (
    "orders_ingest",
    "customers_scd2",
    "products_catalog",
    "events_clickstream",
    "reviews_enrichment",
)
FAILURE_CLASSES = (
    "job_crash",
    "schema_drift",
    "duplicate_explosion",
    "null_spike",
    "volume_anomaly",
    "late_data",
)  # position = priority, most structural first
UNRANKED_PRIORITY = 99
STATUSES = ("OPEN", "INVESTIGATING", "AWAITING_APPROVAL", "RESOLVED")
APPROVABLE_STATUSES = ("AWAITING_APPROVAL", "INVESTIGATING", "OPEN")
PROMOTED_CLASSES = ("job_crash", "schema_drift")
DETECTORS = ("workflow", "poller")
REMEDIATION_TYPES = (
    "retry_adjusted_config",
    "quarantine_reprocess",
    "schema_evolution_ddl",
    "diagnosis_only",
)

# --- fixed values: baselines ----------------------------------------------------
MIN_HISTORY = 7
NULL_RATE_LIMIT = 0.20
VOLUME_LOW = 0.5
VOLUME_HIGH = 2.0
DURATION_LIMIT = 3.0
Z_LIMIT = 3.0
SIGMA_FLOOR = 1e-9
IQR_FENCE = 1.5
SLOW_FACTOR = 2.0

# --- fixed values: check name or metric fragment -> failure class, first hit wins ---
CHECK_FRAGMENTS = (
    ("null", "null_spike"),
    ("duplicate", "duplicate_explosion"),
    ("dup", "duplicate_explosion"),
    ("volume", "volume_anomaly"),
    ("row_count", "volume_anomaly"),
    ("late", "late_data"),
    ("lag", "late_data"),
    ("schema", "schema_drift"),
)
DEFAULT_CHECK_CLASS = "null_spike"

# --- fixed values: logs ---------------------------------------------------------
ERROR_WORDS = "Exception|Error|OOM|OutOfMemoryError|Traceback"
NO_SIGNATURE = "unknown_failure"

# --- fixed values: text and retrieval -------------------------------------------
TOKEN_PATTERN = "[a-z0-9_]+"
EMBED_DIM = 256
CHUNK_CHARS = 900

# --- fixed values: failure class -> remediation type and parameters ---------------
REMEDIATIONS = {
    "job_crash": (
        "retry_adjusted_config",
        {
            "spark.sql.shuffle.partitions": "200",
            "maxRecordsPerFile": "50000",
            "max_retries": "2",
            "timeout_seconds": "3600",
        },
    ),
    "schema_drift": ("schema_evolution_ddl", {"action": "generate_and_apply_additive"}),
    "duplicate_explosion": (
        "quarantine_reprocess",
        {"strategy": "keep_latest_per_key", "key": "order_id"},
    ),
    "null_spike": (
        "quarantine_reprocess",
        {"strategy": "drop_null_keys", "column": "email", "key": "customer_id"},
    ),
    "volume_anomaly": (
        "diagnosis_only",
        {"reason": "no safe automatic remediation for volume spikes"},
    ),
    "late_data": ("retry_adjusted_config", {"lookback_hours": "168", "mode": "replay_window"}),
}

# --- fixed values: failure class -> root-cause sentence ----------------------------
CAUSES = {
    "null_spike": "Null rate exceeded threshold on a monitored column (DQ null check failed).",
    "duplicate_explosion": "Natural-key duplicate rate exceeded threshold after a join/merge.",
    "late_data": "Event lag exceeded the late-data watermark (pct_late / lag_minutes).",
    "volume_anomaly": "Row volume moved outside the cold-start/z-score envelope vs prior runs.",
}

# --- fixed values: pipeline -> source path fragment used to match commits -----------
PATH_HINTS = {
    "orders_ingest": "src/demo",
    "customers_scd2": "src/demo",
    "products_catalog": "src/demo",
    "events_clickstream": "src/demo",
    "reviews_enrichment": "src/demo",
    "ops_force_fail": "src/ops",
}
DEFAULT_PATH_HINT = "src/"

# --- fixed values: grading --------------------------------------------------------
GRADE_MIN_MEAN = 1.6
GRADE_MAX_ZEROS = 1
GRADE_MIN_N = 18

LATE_MINUTES = 2880.0

"""Fixed vocabularies and Spark schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Run states in wire-code order; the code of STATES[i] is i + 1, 0 is "unspecified".
STATES = [
    "CREATED",
    "RUNNING",
    "CHECKPOINTING",
    "COMMITTED",
    "FAILED",
    "RECOVERING",
    "CANCELLED",
    "COMPLETED",
]

# Allowed run state changes.
EDGES = [
    ("CREATED", "RUNNING"),
    ("CREATED", "CANCELLED"),
    ("RUNNING", "CHECKPOINTING"),
    ("RUNNING", "FAILED"),
    ("RUNNING", "CANCELLED"),
    ("RUNNING", "COMPLETED"),
    ("CHECKPOINTING", "COMMITTED"),
    ("CHECKPOINTING", "FAILED"),
    ("CHECKPOINTING", "RUNNING"),
    ("COMMITTED", "RUNNING"),
    ("COMMITTED", "COMPLETED"),
    ("COMMITTED", "FAILED"),
    ("FAILED", "RECOVERING"),
    ("FAILED", "CANCELLED"),
    ("RECOVERING", "RUNNING"),
    ("RECOVERING", "FAILED"),
    ("RECOVERING", "CANCELLED"),
]

# Fixed values.
TERMINAL_STATES = ["CANCELLED", "COMPLETED"]
ACTIVE_STATES = ["RUNNING", "CHECKPOINTING"]
RESUMABLE_STATES = ["RUNNING", "COMMITTED", "CHECKPOINTING", "FAILED", "RECOVERING"]
CHECKPOINT_STATES = ["PENDING", "IN_PROGRESS", "COMMITTED", "FAILED"]
OPEN_CHECKPOINT_STATES = ["PENDING", "IN_PROGRESS"]
SHARDING_POLICIES = ["FULL_REPLICATION", "RANGE_SHARDING", "HASH_SHARDING", "ROUND_ROBIN"]

# Histogram bucket bounds in seconds.
SHARD_BOUNDS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
COMMIT_BOUNDS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]

CHUNK_BYTES = 4 * 1024 * 1024
MANIFEST_NAME = "_manifest.json"

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())

RUN_CONFIG = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("num_workers", T.IntegerType()),
        T.StructField("sharding_policy", T.StringType()),
        T.StructField("checkpoint_interval_steps", T.IntegerType()),
        T.StructField("max_steps", T.LongType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("metadata", _TEXT_MAP),
    ]
)

RUN = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("current_step", T.LongType()),
        T.StructField("num_workers", T.IntegerType()),
        T.StructField("active_workers", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("config", RUN_CONFIG),
        T.StructField("last_checkpoint_id", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("metadata", _TEXT_MAP),
    ]
)

CHECKPOINT = T.StructType(
    [
        T.StructField("checkpoint_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("num_shards", T.IntegerType()),
        T.StructField("total_bytes", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("committed_at", T.TimestampType()),
        T.StructField("shard_ids", T.ArrayType(T.StringType())),
        T.StructField("metadata", _TEXT_MAP),
    ]
)

WORKER = T.StructType(
    [
        T.StructField("worker_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("last_heartbeat", T.TimestampType()),
        T.StructField("current_step", T.LongType()),
        T.StructField("metadata", _TEXT_MAP),
    ]
)

DATASET = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("total_size_bytes", T.LongType()),
        T.StructField("num_shards", T.IntegerType()),
        T.StructField("sharding_policy", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("metadata", _TEXT_MAP),
    ]
)

ENTITIES = {"runs": RUN, "checkpoints": CHECKPOINT, "workers": WORKER, "datasets": DATASET}

# What fields that a stored entity leaves out are read as; all others are null.
ENTITY_DEFAULTS = {
    "runs": {"current_step": 0, "num_workers": 0, "active_workers": 0, "metadata": {}},
    "checkpoints": {"state": "PENDING", "num_shards": 0, "total_bytes": 0, "shard_ids": [], "metadata": {}},
    "workers": {"hostname": "", "status": "ACTIVE", "current_step": 0, "metadata": {}},
    "datasets": {"total_size_bytes": 0, "num_shards": 0, "sharding_policy": "RANGE_SHARDING", "metadata": {}},
}
RUN_CONFIG_DEFAULTS = {"sharding_policy": "RANGE_SHARDING", "checkpoint_interval_steps": 500, "metadata": {}}

MANIFEST_SHARD = T.StructType(
    [
        T.StructField("shard_id", T.StringType()),
        T.StructField("rank", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("storage_key", T.StringType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("checkpoint_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("num_shards", T.LongType()),
        T.StructField("total_bytes", T.LongType()),
        T.StructField("shards", T.ArrayType(MANIFEST_SHARD)),
        T.StructField("metadata", _TEXT_MAP),
    ]
)

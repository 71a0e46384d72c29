"""The ledger's tables and the values that its columns take."""

from __future__ import annotations

from pyspark.sql import types as T

#: The statuses.
QUEUED, RUNNING, SUCCEEDED, FAILED, CANCELED = STATUSES = ("queued", "running", "succeeded", "failed", "canceled")
TERMINAL = (SUCCEEDED, FAILED, CANCELED)
#: What a keyed submission does when its key has a task already.
CONFLICTS = ("reuse", "reuse-succeeded", "reject", "replace")

TASK_SCHEMA = T.StructType(
    [
        T.StructField(name, kind, nullable)
        for name, kind, nullable in (
            ("id", T.StringType(), False),
            ("name", T.StringType(), False),
            ("queue", T.StringType(), False),
            ("status", T.StringType(), False),
            ("payload", T.StringType(), False),
            ("result", T.StringType(), True),
            ("error", T.StringType(), True),
            ("metadata", T.StringType(), False),
            ("progress", T.DoubleType(), True),
            ("message", T.StringType(), True),
            ("attempt", T.IntegerType(), False),
            ("max_attempts", T.IntegerType(), False),
            ("priority", T.IntegerType(), False),
            ("worker_id", T.StringType(), True),
            ("lease_until_ms", T.LongType(), True),
            ("run_at_ms", T.LongType(), False),
            ("cancel_requested_at_ms", T.LongType(), True),
            ("parent_id", T.StringType(), True),
            ("root_id", T.StringType(), True),
            ("correlation_id", T.StringType(), True),
            ("created_at_ms", T.LongType(), False),
            ("updated_at_ms", T.LongType(), False),
            ("completed_at_ms", T.LongType(), True),
        )
    ]
)
TASK_COLUMNS = TASK_SCHEMA.fieldNames()
KEY_SCHEMA = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("task_id", T.StringType(), False), T.StructField("created_at_ms", T.LongType(), False), T.StructField("updated_at_ms", T.LongType(), False)])

#: Fixed value: the error that lease recovery records.
LEASE_EXPIRED = '{"type":"LeaseExpired","code":"lease_expired","message":"task lease expired and max attempts reached","retryable":false,"details":{}}'
#: The error that stands for one that is no JSON object.
UNWRITABLE_ERROR = '{"type":"EncodingError","code":"error_not_serializable","message":"the error could not be written as JSON","retryable":false,"details":{}}'

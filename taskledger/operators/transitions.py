"""State transitions: each returns the changed rows as they are afterwards.

The result is both what the operation returns and what `plans.apply_changes` puts into the table.
Times are milliseconds; one `now` holds for a whole operation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import cancel_asked, checked, is_due, is_expired, is_owned, is_terminal, json_object_or, one_of, will_retry
from .reads import with_chunks
from ..schema import CANCELED, FAILED, LEASE_EXPIRED, QUEUED, RUNNING, SUCCEEDED, TASK_COLUMNS, TASK_SCHEMA, TERMINAL, UNWRITABLE_ERROR


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _ms(value: int | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("long")


def insert_tasks(submissions: DataFrame, now: int | Column, *more: str) -> DataFrame:
    """Queued rows, put in at one time or at a column's, for submissions (id, name, payload; optionally queue, metadata, max_attempts, priority, delay_ms, parent_id, root_id, correlation_id). A task without a root is its own. A row with max_attempts under 1 or a negative delay ends the query with an error. more: columns that stay beside them."""
    have = set(submissions.columns)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    values = {
        "id": F.col("id"), "name": F.col("name"), "queue": given("queue", F.lit("default")), "status": F.lit(QUEUED), "payload": F.col("payload"), "result": _null("string"), "error": _null("string"),
        "metadata": given("metadata", F.lit("{}")), "progress": _null("double"), "message": _null("string"), "attempt": F.lit(0), "max_attempts": checked(given("max_attempts", F.lit(3)).cast("int"), lambda n: n >= 1, "max_attempts must be at least 1"),
        "priority": given("priority", F.lit(0)).cast("int"), "worker_id": _null("string"), "lease_until_ms": _null("long"), "run_at_ms": _ms(now) + checked(given("delay_ms", F.lit(0)).cast("long"), lambda n: n >= 0, "delay_ms must not be negative"), "cancel_requested_at_ms": _null("long"),
        "parent_id": given("parent_id", _null("string")), "root_id": given("root_id", F.col("id")), "correlation_id": given("correlation_id", _null("string")), "created_at_ms": _ms(now), "updated_at_ms": _ms(now), "completed_at_ms": _null("long"),
    }
    return submissions.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in TASK_SCHEMA], *more)


def spawn(tasks: DataFrame, children: DataFrame, now: int) -> DataFrame:
    """Queued rows for the children (parent_id, and children: an array of structs that insert_tasks takes, with an id) of tasks: of their parent's root, and of its correlation unless a child has its own. Children of unknown parents are dropped."""
    fields = [f.name for f in children.schema["children"].dataType.elementType.fields]
    each = children.select("parent_id", F.explode("children").alias("child")).select("parent_id", *[F.col(f"child.`{c}`").alias(c) for c in fields])
    parents = tasks.select(F.col("id").alias("parent_id"), F.coalesce("root_id", "id").alias("root_id"), F.col("correlation_id").alias("_correlation"))
    rows = each.join(parents, "parent_id")
    own = F.coalesce("correlation_id", "_correlation") if "correlation_id" in fields else F.col("_correlation")
    return insert_tasks(rows.withColumn("correlation_id", own).drop("_correlation"), now)


def handle(claimed: DataFrame, batch_sizes: dict[str, int], handler: Callable[[str, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What `handler(name, tasks)` makes of each delivery (see reads.deliveries): rows of `schema`. A delivery has its name's batch size at most, and goes to one call. A handler that raises ends the query: settle.deliver() makes outcomes of that."""

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        return handler(rows["name"].iloc[0], rows.drop(columns="chunk"))

    return with_chunks(claimed, batch_sizes).groupBy("name", "chunk").applyInPandas(call, schema)


def claim(tasks: DataFrame, worker: str, now: int, lease_ms: int, limit: int, queues: Sequence[str] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """The due tasks of highest priority, then earliest run_at_ms, then least id, leased to the worker.

    Each partition keeps `limit` rows before they meet (TakeOrderedAndProject): nothing is sorted whole.
    """
    due = tasks.where(is_due(now) & one_of("queue", queues) & one_of("name", names))
    first = due.orderBy(F.col("priority").desc(), "run_at_ms", "id").limit(limit)
    return first.withColumns({"status": F.lit(RUNNING), "worker_id": F.lit(worker), "lease_until_ms": _ms(now + lease_ms), "attempt": F.col("attempt") + 1, "updated_at_ms": _ms(now)})


def recover_leases(tasks: DataFrame, now: int) -> DataFrame:
    """Tasks whose lease has ended: canceled if that was asked, queued again if attempts are left, else failed."""
    again = will_retry()
    over = ~cancel_asked() & ~again
    return tasks.where(is_expired(now)).withColumns(
        {
            "status": F.when(cancel_asked(), CANCELED).when(again, QUEUED).otherwise(FAILED),
            "error": F.when(over, LEASE_EXPIRED).otherwise(F.col("error")),
            "progress": F.when(~again, F.col("progress")),
            "message": F.when(~again, F.col("message")),
            "worker_id": F.when(~again, F.col("worker_id")),
            "lease_until_ms": _null("long"),
            "run_at_ms": F.when(again, now).otherwise(F.col("run_at_ms")).cast("long"),
            "completed_at_ms": F.when(again, F.col("completed_at_ms")).otherwise(now).cast("long"),
            "updated_at_ms": _ms(now),
        }
    )


def claim_session(tasks: DataFrame, worker: str, now: int, lease_ms: int, limit: int, queues: Sequence[str] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """What a worker claims once ended leases are recovered, in one snapshot."""
    recovered = recover_leases(tasks, now)
    return claim(tasks.where(~F.coalesce(is_expired(now), F.lit(False))).unionByName(recovered), worker, now, lease_ms, limit, queues, names)


def _settled(now: int) -> dict[str, Column]:
    return {"lease_until_ms": _null("long"), "completed_at_ms": _ms(now), "updated_at_ms": _ms(now)}


def _of(tasks: DataFrame, writes: DataFrame, now: int) -> DataFrame:
    """Tasks joined to owned writes (id, worker, and arguments): those whose worker holds the lease. Arguments come as columns with _ before their names."""
    named = writes.select(*[F.col(c).alias(f"_{c}") for c in writes.columns])
    return tasks.join(named, tasks["id"] == F.col("_id")).where(is_owned(F.col("_worker"), now))


def _tasks_only(rows: DataFrame) -> DataFrame:
    return rows.select(*TASK_COLUMNS)


def heartbeat(tasks: DataFrame, beats: DataFrame, now: int, lease_ms: int) -> DataFrame:
    """Leases renewed for beats (id, worker); tasks that the worker has lost are absent."""
    return _tasks_only(_of(tasks, beats, now).withColumns({"lease_until_ms": _ms(now + lease_ms), "updated_at_ms": _ms(now)}))


def heartbeat_batch(tasks: DataFrame, beats: DataFrame, now: int, lease_ms: int) -> DataFrame:
    """(id, cancel_requested) of each task renewed."""
    return heartbeat(tasks, beats, now, lease_ms).select("id", cancel_asked().alias("cancel_requested"))


def report_progress(tasks: DataFrame, reports: DataFrame, now: int) -> DataFrame:
    """reports: (id, worker, progress, message); a null leaves what is there."""
    rows = _of(tasks, reports, now)
    return _tasks_only(rows.withColumns({"progress": F.coalesce("_progress", "progress"), "message": F.coalesce("_message", "message"), "updated_at_ms": _ms(now)}))


def succeeded_values(now: int) -> dict[str, Column]:
    """What success in any case changes, given _result and _message."""
    return {"status": F.lit(SUCCEEDED), "result": F.col("_result"), "progress": F.lit(1.0), "message": F.coalesce("_message", "message"), **_settled(now)}


def completed_values(now: int) -> dict[str, Column]:
    """What completion changes, given _result."""
    stop = cancel_asked()
    values = {"status": F.when(stop, CANCELED).otherwise(SUCCEEDED), "result": F.when(stop, F.col("result")).otherwise(F.col("_result")), "progress": F.when(stop, F.col("progress")).otherwise(1.0)}
    return values | _settled(now)


def failed_values(now: int) -> dict[str, Column]:
    """What a failure changes, given _error, _retryable and _delay_ms."""
    again = will_retry(F.coalesce(F.col("_retryable"), F.lit(True)))
    return {
        "status": F.when(cancel_asked(), CANCELED).when(again, QUEUED).otherwise(FAILED),
        "error": json_object_or(F.col("_error"), UNWRITABLE_ERROR),
        "progress": F.when(~again, F.col("progress")),
        "message": F.when(~again, F.col("message")),
        "worker_id": F.when(~again, F.col("worker_id")),
        "lease_until_ms": _null("long"),
        "run_at_ms": F.when(again, now + F.coalesce(F.col("_delay_ms"), F.lit(0))).otherwise(F.col("run_at_ms")).cast("long"),
        "completed_at_ms": F.when(~again, now).cast("long"),
        "updated_at_ms": _ms(now),
    }


def succeed(tasks: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """outcomes: (id, worker, result, message). Succeeded whatever was asked since."""
    return _tasks_only(_of(tasks, outcomes, now).withColumns(succeeded_values(now)))


def complete(tasks: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """outcomes: (id, worker, result). Canceled if that was asked, then without result; else succeeded."""
    return _tasks_only(_of(tasks, outcomes, now).withColumns(completed_values(now)))


def fail(tasks: DataFrame, failures: DataFrame, now: int) -> DataFrame:
    """failures: (id, worker, error, retryable, delay_ms). Canceled if that was asked, queued again after the delay if it is retryable (or null) and attempts are left, else failed; the error is recorded in any case, a stand-in where it is no JSON object."""
    return _tasks_only(_of(tasks, failures, now).withColumns(failed_values(now)))


def lost_leases(tasks: DataFrame, writes: DataFrame, now: int) -> DataFrame:
    """Owned writes (id, worker, ...) that match no task which their worker holds."""
    held = tasks.where((F.col("status") == RUNNING) & (F.col("lease_until_ms") > now)).select(F.col("id").alias("_id"), F.col("worker_id").alias("_worker"))
    return writes.join(held, (writes["id"] == F.col("_id")) & (writes["worker"] == F.col("_worker")), "left_anti")


def canceled_values(now: int) -> dict[str, Column]:
    """What a cancel changes of a queued or running task."""
    queued = F.col("status") == QUEUED
    return {
        "status": F.when(queued, CANCELED).otherwise(F.col("status")),
        "cancel_requested_at_ms": F.when(queued, F.col("cancel_requested_at_ms")).otherwise(now).cast("long"),
        "completed_at_ms": F.when(queued, now).otherwise(F.col("completed_at_ms")).cast("long"),
        "updated_at_ms": _ms(now),
    }


def cancel(tasks: DataFrame, now: int, ids: DataFrame | None = None) -> DataFrame:
    """Queued tasks canceled at once, running ones asked to stop; of `ids` (id) if given."""
    rows = tasks if ids is None else tasks.join(ids.select("id").distinct(), "id", "left_semi")
    return rows.where(F.col("status").isin(QUEUED, RUNNING)).withColumns(canceled_values(now))


def retry(tasks: DataFrame, now: int, ids: DataFrame | None = None, reset_attempts: bool = False) -> DataFrame:
    """Failed and canceled tasks queued again, as if new but for their attempts (unless reset) and result; of `ids` (id) if given."""
    rows = tasks if ids is None else tasks.join(ids.select("id").distinct(), "id", "left_semi")
    empty = {c: _null(k) for c, k in (("error", "string"), ("progress", "double"), ("message", "string"), ("worker_id", "string"), ("lease_until_ms", "long"), ("cancel_requested_at_ms", "long"), ("completed_at_ms", "long"))}
    attempt = F.lit(0) if reset_attempts else F.col("attempt")
    return rows.where(F.col("status").isin(FAILED, CANCELED)).withColumns({"status": F.lit(QUEUED), "attempt": attempt, "run_at_ms": _ms(now), "updated_at_ms": _ms(now), **empty})


def check_purge(older_than_ms: int, status: str | None, limit: int) -> None:
    if older_than_ms < 0:
        raise ValueError("older_than_ms must not be negative")
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if status is not None and status not in TERMINAL:
        raise ValueError("only terminal tasks can be purged")


def purge(tasks: DataFrame, now: int, older_than_ms: int, limit: int = 1000, queue: str | None = None, status: str | None = None, name: str | None = None) -> DataFrame:
    """Ids of the longest completed terminal tasks beyond the age, `limit` at most; ties by id."""
    check_purge(older_than_ms, status, limit)
    old = tasks.where(is_terminal() & (F.col("completed_at_ms") < now - older_than_ms))
    for column, value in (("queue", queue), ("status", status), ("name", name)):
        if value is not None:
            old = old.where(F.col(column) == value)
    return old.orderBy("completed_at_ms", "id").limit(limit).select("id")


def purge_by_rules(tasks: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """Ids of terminal tasks that some rule (older_than_ms, and queue, status, name or null, and perhaps limit) lets go; a task that several match once.

    A rule with a limit lets go the longest completed of its tasks, so many at most, ties by id; a task counts under each rule that it matches.
    Rules are few and broadcast, which Spark needs for a join by inequality; their number is checked. Each partition cuts a rule's tasks to the largest limit before they meet.
    """
    given = rules.limit(1001).collect()
    if len(given) > 1000:
        raise ValueError("more than 1000 retention rules")
    limits = [r.limit for r in given if r.limit is not None] if "limit" in rules.columns else []
    if any(n < 1 for n in limits):
        raise ValueError("limit must be at least 1")
    fields = ("older_than_ms", "queue", "status", "name")
    schema = "_rule int, _older_than_ms long, _queue string, _status string, _name string, _limit int"
    rows = [(i, *[r[c] if c in rules.columns else None for c in fields], r.limit if "limit" in rules.columns else None) for i, r in enumerate(given)]
    rule = F.broadcast(tasks.sparkSession.createDataFrame(rows, schema))
    match = F.col("completed_at_ms") < F.lit(now) - F.col("_older_than_ms")
    for c in fields[1:]:
        match = match & (F.col(f"_{c}").isNull() | (F.col(c) == F.col(f"_{c}")))
    old = tasks.where(is_terminal())
    gone = old.join(rule.where("_limit is null"), match, "left_semi").select("id")
    if not limits:
        return gone
    first = Window.partitionBy("_rule").orderBy("completed_at_ms", "id")
    bounded = old.join(rule.where("_limit is not null"), match).select("id", "completed_at_ms", "_rule", "_limit").withColumn("_n", F.row_number().over(first))
    return gone.union(bounded.where((F.col("_n") <= max(limits)) & (F.col("_n") <= F.col("_limit"))).select("id")).distinct()


def purged_keys(keys: DataFrame, purged: DataFrame) -> DataFrame:
    """Rows of keys whose task is purged: they go with it."""
    return keys.join(purged, keys["task_id"] == purged["id"], "left_semi")

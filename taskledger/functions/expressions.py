"""Predicates and values of the task state machine, as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import QUEUED, RUNNING, TERMINAL


def is_due(now: int) -> Column:
    return (F.col("status") == QUEUED) & (F.col("run_at_ms") <= now)


def is_expired(now: int) -> Column:
    return (F.col("status") == RUNNING) & (F.col("lease_until_ms") <= now)


def is_owned(worker: Column | str, now: int) -> Column:
    """Whether the worker holds a lease that hasn't ended: an owned write's condition."""
    worker = F.lit(worker) if isinstance(worker, str) else worker
    return (F.col("status") == RUNNING) & (F.col("worker_id") == worker) & (F.col("lease_until_ms") > now)


def is_terminal() -> Column:
    return F.col("status").isin(*TERMINAL)


def cancel_asked() -> Column:
    return F.col("cancel_requested_at_ms").isNotNull()


def will_retry(retryable: Column | bool = True) -> Column:
    """Whether a task that leaves running goes back to its queue: no cancel asked, retryable, and attempts left."""
    retryable = F.lit(retryable) if isinstance(retryable, bool) else retryable
    return ~cancel_asked() & retryable & (F.col("attempt") < F.col("max_attempts"))


def one_of(column: str, values: Sequence[str] | None) -> Column:
    """Whether the column is one of the values; None is no filter, and no values match nothing."""
    if values is None:
        return F.lit(True)
    return F.col(column).isin(*values) if values else F.lit(False)


def backoff_window(attempt: Column, base_ms: int, max_ms: int) -> Column:
    """The longest delay before the next attempt: base doubled with each, at most max; 0 without a base."""
    if base_ms <= 0:
        return F.lit(0).cast("long")
    return F.least(F.lit(float(max_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))).cast("long")


def backoff_delay(attempt: Column, base_ms: int, max_ms: int, random: Column, retryable: Column | bool = True) -> Column:
    """Half of the window, and a random share (0 to 1) of the rest; 0 for what isn't retried."""
    window = backoff_window(attempt, base_ms, max_ms)
    half = F.floor(window / 2)
    retryable = F.lit(retryable) if isinstance(retryable, bool) else retryable
    return F.when(retryable, half + F.floor(random * (window - half))).otherwise(0).cast("long")


def checked(value: Column, holds: Callable[[Column], Column], message: str) -> Column:
    """The value; where it doesn't hold the query ends with the message."""
    return F.when(F.coalesce(holds(value), F.lit(True)), value).otherwise(F.raise_error(message).cast("long"))


def json_object_or(value: Column, other: str) -> Column:
    """The value if it is null or a JSON object, else the other."""
    return F.when(value.isNull() | (F.json_object_keys(value).isNotNull() & value.rlike(r"^\s*\{")), value).otherwise(other)


def payload_bytes() -> Column:
    return F.octet_length("payload").cast("long")

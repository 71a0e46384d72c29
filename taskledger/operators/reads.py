"""Reads: points, lists, statistics, depth and probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import is_due, is_expired, one_of, payload_bytes
from ..plans.ranges import numbered
from ..schema import QUEUED, STATUSES


def get(tasks: DataFrame, task_id: str) -> DataFrame:
    return tasks.where(F.col("id") == task_id)


def get_status(tasks: DataFrame, task_id: str) -> DataFrame:
    return get(tasks, task_id).select("id", "status")


def get_key(keys: DataFrame, key: str) -> DataFrame:
    return keys.where(F.col("key") == key).select("task_id")


def get_by_key(tasks: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The task that the key points to now: a row or none. A key is there once."""
    return tasks.join(F.broadcast(get_key(keys, key).limit(1)), F.col("id") == F.col("task_id"), "left_semi")


def get_status_by_key(tasks: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return get_by_key(tasks, keys, key).select("id", "status")


def current_tasks(tasks: DataFrame, keys: DataFrame) -> DataFrame:
    """Every key with the task it points to."""
    return keys.select("key", F.col("task_id").alias("id")).join(tasks, "id")


def list_tasks(
    tasks: DataFrame, status: str | None = None, queue: str | None = None, name: str | None = None, root_id: str | None = None, correlation_id: str | None = None, limit: int = 100, offset: int = 0
) -> DataFrame:
    """A page of tasks, latest first; filters that are given are pushed down to the scan."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    for column, value in (("status", status), ("queue", queue), ("name", name), ("root_id", root_id), ("correlation_id", correlation_id)):
        if value is not None:
            tasks = tasks.where(F.col(column) == value)
    return tasks.orderBy(F.col("created_at_ms").desc(), F.col("id").desc()).offset(offset).limit(limit)


def claimable_probe(tasks: DataFrame, now: int, queues: Sequence[str] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """(claimable): whether a due task matches the filters, or any lease has ended. One row, also for an empty table."""
    found = tasks.where((is_due(now) & one_of("queue", queues) & one_of("name", names)) | is_expired(now)).limit(1)
    return found.agg((F.count("*") > 0).alias("claimable"))


def stats(tasks: DataFrame, queue: str | None = None) -> DataFrame:
    """(queue, status, n) with zeros for all statuses of every queue that has a row, and of the one asked for."""
    rows = tasks if queue is None else tasks.where(F.col("queue") == queue)
    counted = rows.groupBy("queue").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    if queue is not None:
        one = tasks.sparkSession.range(1).select(F.lit(queue).alias("queue"))
        counted = one.join(counted, "queue", "left").na.fill(0, STATUSES)
    return counted.unpivot("queue", list(STATUSES), "status", "n")


def stats_wide(tasks: DataFrame) -> DataFrame:
    """A row for each queue and a column for each status."""
    return tasks.groupBy("queue").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def queue_depth(tasks: DataFrame, queue: str, max_depth: int) -> DataFrame:
    """(headroom): how many more tasks the queue takes, not below 0; at most max_depth rows are counted."""
    if max_depth < 0:
        raise ValueError("max_depth must not be negative")
    return tasks.where((F.col("queue") == queue) & (F.col("status") == QUEUED)).limit(max_depth).agg((F.lit(max_depth) - F.count("*")).cast("long").alias("headroom"))


def with_chunks(claimed: DataFrame, batch_sizes: dict[str, int]) -> DataFrame:
    """claimed with `chunk`: calls of at most their name's batch size, one by one for names without. A name of very many tasks is numbered by ranges."""
    size = F.lit(1)
    for name, n in batch_sizes.items():
        size = F.when(F.col("name") == name, n).otherwise(size)
    places = numbered(claimed, ["name"], [F.col("priority").desc(), F.col("run_at_ms"), F.col("id")])
    return places.withColumn("chunk", F.floor(F.col("place") / size).cast("long")).drop("place")


def deliveries(claimed: DataFrame, batch_sizes: dict[str, int]) -> DataFrame:
    """(id, name, chunk) of with_chunks()."""
    return with_chunks(claimed.select("id", "name", "priority", "run_at_ms"), batch_sizes).select("id", "name", "chunk")


def claim_by_quota(tasks: DataFrame, quotas: dict[str, int], now: int, queues: Sequence[str] | None = None) -> DataFrame:
    """(id, name, place): the first tasks of each name up to its quota. Spark cuts each partition to the quota before the shuffle."""
    order = Window.partitionBy("name").orderBy(F.col("priority").desc(), "run_at_ms", "id")
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col("name") == name, n).otherwise(quota)
    most = max(quotas.values(), default=0)
    ranked = tasks.where(is_due(now) & one_of("queue", queues) & one_of("name", list(quotas))).withColumn("place", F.row_number().over(order).cast("long"))
    return ranked.where((F.col("place") <= most) & (F.col("place") <= quota)).select("id", "name", "place")


def claim_by_budget(tasks: DataFrame, quotas: dict[str, int], now: int, budget: int, start: int = 0, queues: Sequence[str] | None = None) -> DataFrame:
    """(id, name, place): draws for the names in turn, from that at `start` (modulo their number) on; each gets up to its quota of what the names before have left of the budget."""
    names = list(quotas)
    turn = F.lit(None).cast("int")
    for i, name in enumerate(names[start % len(names) :] + names[: start % len(names)] if names else []):
        turn = F.when(F.col("name") == name, i).otherwise(turn)
    drawn = claim_by_quota(tasks, quotas, now, queues).withColumn("_turn", turn)
    before = Window.orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)  # a row a name
    left = drawn.groupBy("_turn").agg(F.count("*").alias("_n")).select("_turn", (F.lit(budget) - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_left"))
    return drawn.join(F.broadcast(left), "_turn").where(F.col("place") <= F.col("_left")).select("id", "name", "place")


def within_bytes(claimed: DataFrame, budget: int, in_flight: DataFrame | None = None) -> DataFrame:
    """(id, name, bytes): of each name's claimed tasks, in order of claims, those whose payloads fit what the budget leaves beside those of its tasks in flight. With nothing in flight the first goes in any case, alone if it is oversized."""
    rows = numbered(claimed.select("id", "name", "priority", "run_at_ms", payload_bytes().alias("bytes")), ["name"], [F.col("priority").desc(), F.col("run_at_ms"), F.col("id")], ["bytes"])
    held = F.lit(0)
    if in_flight is not None:
        rows = rows.join(in_flight.groupBy("name").agg(F.sum(payload_bytes()).alias("_held")), "name", "left")
        held = F.coalesce("_held", F.lit(0))
    return rows.where((F.col("before_bytes") + F.col("bytes") + held <= budget) | (F.col("place") == 0) & (held == 0)).select("id", "name", "bytes")


def admitted(arrivals: DataFrame, tasks: DataFrame, limits: int | dict[str, int], order: Sequence[str] = ("seq",)) -> DataFrame:
    """arrivals (queue, and the columns of an order without ties) with `place`, from 0 in their queue, and `admitted`: whether the queue, which holds so many queued tasks at most, has room for it.

    limits: one for every queue, or by queue, where queues without have none. Rows with a null queue go to `default`. A queue that most rows go to is numbered by ranges.
    """
    if any(n < 1 for n in (limits.values() if isinstance(limits, dict) else [limits])):
        raise ValueError("a limit must be at least 1")
    rows = arrivals.withColumn("queue", F.coalesce("queue", F.lit("default")))
    depth = tasks.where(F.col("status") == QUEUED).groupBy("queue").agg(F.count("*").alias("_depth"))
    most = F.lit(None).cast("long") if isinstance(limits, dict) else F.lit(limits)
    for queue, n in limits.items() if isinstance(limits, dict) else ():
        most = F.when(F.col("queue") == queue, n).otherwise(most)
    places = numbered(rows, ["queue"], [F.col(c) for c in order]).join(depth, "queue", "left")
    fits = F.col("place") + F.coalesce("_depth", F.lit(0)) < most
    return places.withColumn("admitted", F.coalesce(fits, F.lit(True))).drop("_depth")


def percentiles(rows: DataFrame, by: str, value: str, shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """(by, share, value) by nearest rank: the least value that at least the share of the group's values doesn't exceed."""
    found = F.array(*[F.struct(F.lit(p).alias("share"), F.expr(f"percentile_disc({p}D) within group (order by `{value}`)").alias("value")) for p in shares])
    return rows.groupBy(by).agg(found.alias("p")).select(by, F.explode("p").alias("p")).select(by, "p.share", F.col("p.value").alias("value"))


def payload_sizes(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("name").agg(F.sum(payload_bytes()).alias("bytes"), F.count("*").alias("n"))


def backlog_age(tasks: DataFrame, now: int) -> DataFrame:
    """(queue, n, oldest_ms) of due tasks."""
    return tasks.where(is_due(now)).groupBy("queue").agg(F.count("*").alias("n"), (F.lit(now) - F.min("run_at_ms")).cast("long").alias("oldest_ms"))


def attempts_histogram(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status", "attempt").agg(F.count("*").alias("n"))


def change_feed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(reason, queue, id): queued when a task becomes queued, done when it first becomes terminal."""
    old = before.select(F.col("id").alias("_id"), F.col("status").alias("_was"))
    rows = after.join(old, after["id"] == F.col("_id"), "left").where(~F.col("_was").eqNullSafe(F.col("status")))
    done = F.col("status").isin(*STATUSES[2:]) & ~F.coalesce(F.col("_was").isin(*STATUSES[2:]), F.lit(False))
    reason = F.when(F.col("status") == QUEUED, "queued").when(done, "done")
    return rows.select(reason.alias("reason"), "queue", "id").where("reason is not null")

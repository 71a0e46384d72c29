"""Ordered command logs folded into final task states.

A command is (id, seq, op, worker, now_ms, and arguments). A task's row and its commands, in order of
seq, pass through one task of the cluster, which holds the current state alone: a log may be of any length.
An owned command whose worker doesn't hold the lease changes nothing and counts as lost; so does any without a time.

A log may hold keyed submissions, too. It is folded twice then: by key, to see which task a key names and what becomes of each
submission, for which the state of the key's present task is enough; then by id, with tasks that are put in where they begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.ranges import kept
from ..schema import CANCELED, CONFLICTS, FAILED, LEASE_EXPIRED, QUEUED, RUNNING, SUCCEEDED
from .transitions import insert_tasks

COMMANDS = ("claim", "heartbeat", "progress", "complete", "succeed", "fail", "cancel", "retry", "expire")
OWNED = ("heartbeat", "progress", "complete", "succeed", "fail")
#: Columns that a fold carries, with their types.
STATE = {
    "status": "string", "result": "string", "error": "string", "progress": "double", "message": "string", "attempt": "int", "max_attempts": "int", "worker_id": "string", "lease_until_ms": "bigint",
    "run_at_ms": "bigint", "cancel_requested_at_ms": "bigint", "completed_at_ms": "bigint", "updated_at_ms": "bigint", "applied": "bigint", "lost": "bigint",
}
#: Arguments of commands, with their types; those that a log lacks are null.
ARGUMENTS = {"op": "string", "worker": "string", "now_ms": "bigint", "progress": "double", "message": "string", "result": "string", "error": "string", "retryable": "boolean", "delay_ms": "bigint"}


def step(s: dict, c: dict, lease_ms: int, delay_ms: int) -> None:
    """The state s after the command c: the same effects as those of transitions.py. A command without `retryable` is retryable, one without `delay_ms` waits delay_ms."""
    op, now = c["op"], c["now_ms"]
    if now is None:
        s["lost"] += 1
        return
    holds = s["status"] == RUNNING and c["worker"] is not None and s["worker_id"] == c["worker"] and s["lease_until_ms"] > now
    if op in OWNED and not holds:
        s["lost"] += 1
        return
    stop = s["cancel_requested_at_ms"] is not None
    again = not stop and s["attempt"] < s["max_attempts"] and (op != "fail" or c["retryable"] is not False)
    ended = {"lease_until_ms": None, "completed_at_ms": now}
    if op == "claim" and s["status"] == QUEUED and s["run_at_ms"] <= now:
        new = {"status": RUNNING, "worker_id": c["worker"], "lease_until_ms": now + lease_ms, "attempt": s["attempt"] + 1}
    elif op == "heartbeat":
        new = {"lease_until_ms": now + lease_ms}
    elif op == "progress":
        new = {k: c[k] for k in ("progress", "message") if c[k] is not None}
    elif op == "succeed":
        new = ended | {"status": SUCCEEDED, "result": c["result"], "progress": 1.0, "message": s["message"] if c["message"] is None else c["message"]}
    elif op == "complete":
        new = ended | ({"status": CANCELED} if stop else {"status": SUCCEEDED, "result": c["result"], "progress": 1.0})
    elif op == "fail" or op == "expire" and s["status"] == RUNNING and s["lease_until_ms"] <= now:
        new = {"error": c["error"]} if op == "fail" else {} if stop or again else {"error": LEASE_EXPIRED}
        if again:
            wait = 0 if op == "expire" else delay_ms if c["delay_ms"] is None else c["delay_ms"]
            new |= {"status": QUEUED, "progress": None, "message": None, "worker_id": None, "lease_until_ms": None, "run_at_ms": now + wait} | ({"completed_at_ms": None} if op == "fail" else {})
        else:
            new |= ended | {"status": CANCELED if stop else FAILED}
    elif op == "cancel" and s["status"] == QUEUED:
        new = {"status": CANCELED, "completed_at_ms": now}
    elif op == "cancel" and s["status"] == RUNNING:
        new = {"cancel_requested_at_ms": now}
    elif op == "retry" and s["status"] in (FAILED, CANCELED):
        new = {"status": QUEUED, "run_at_ms": now} | dict.fromkeys(("error", "progress", "message", "worker_id", "lease_until_ms", "cancel_requested_at_ms", "completed_at_ms"))
    else:
        return
    s.update(new, updated_at_ms=now, applied=s["applied"] + 1)


def fold_commands(tasks: DataFrame, commands: DataFrame, lease_ms: int = 30_000, delay_ms: int = 1_000) -> DataFrame:
    """(id, and the columns of STATE) of every id that has a command, after all of them.

    commands: (id, seq, and some of ARGUMENTS). applied and lost count commands. An id without a task
    has no state, and all its commands are lost. Commands with a null id are dropped, those with a null seq come first.
    Tasks with a value in a column `born`, if there is one, begin at that seq: they have a state without any command, and commands before are lost.
    """
    log = commands.where("id is not null")
    born = F.col("born") if "born" in tasks.columns else F.lit(None)
    ids = log.select("id").distinct()
    asked = tasks.join(ids, "id", "left_semi") if "born" not in tasks.columns else tasks.join(ids.withColumn("_asked", F.lit(True)), "id", "left").where("_asked or born is not null")
    starts = asked.select("id", born.cast(log.schema["seq"].dataType).alias("seq"), _state().alias("s"), F.lit(None).cast(_type(ARGUMENTS)).alias("c"))
    both = starts.unionByName(log.select("id", "seq", F.lit(None).cast(_type(STATE)).alias("s"), _given(commands).alias("c")))
    out = StructType.fromDDL("id string, " + ", ".join(f"{k} {t}" for k, t in STATE.items()))
    schema = to_arrow_schema(out)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s = None, {}
        for batch in batches:
            done = []
            for id_, start, c in zip(*(x.to_pylist() for x in batch.columns)):
                if id_ != at:
                    done += [{"id": at, **s}] if at is not None else []
                    at, s = id_, dict.fromkeys(STATE) | {"applied": 0, "lost": 0}
                if start is not None:
                    s = start | {"lost": s["lost"]}
                elif s["status"] is None:
                    s["lost"] += 1
                else:
                    step(s, c, lease_ms, delay_ms)
            yield pa.RecordBatch.from_pylist(done, schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"id": at, **s}], schema)

    in_order = both.repartition("id").sortWithinPartitions("id", F.col("seq").asc_nulls_first(), F.col("s").isNull())
    return in_order.select("id", "s", "c").mapInArrow(fold, out)


def _state():
    return F.struct(*[(F.lit(0) if k in ("applied", "lost") else F.col(k)).cast(t).alias(k) for k, t in STATE.items()])


def _given(commands: DataFrame):
    return F.struct(*[(F.col(k) if k in commands.columns else F.lit(None)).cast(t).alias(k) for k, t in ARGUMENTS.items()]).cast(_type(ARGUMENTS))


#: What a submission in a log carries besides id (the new task's), seq, op and now_ms; those that a log lacks are null.
SUBMISSION = {
    "key": "string", "conflict": "string", "name": "string", "queue": "string", "payload": "string", "metadata": "string", "max_attempts": "int", "priority": "int",
    "start_delay_ms": "bigint", "parent_id": "string", "root_id": "string", "correlation_id": "string",
}
SUBMIT, INVALID = "submit", "invalid"


class Folded(NamedTuple):
    """What a log of commands and submissions comes to.

    changes: rows of tasks as they are afterwards, changed and new. pointers: (key, task_id) that are put in place.
    decisions: see decide(). lost: (id, lost, unknown), the commands without effect.
    """

    changes: DataFrame
    pointers: DataFrame
    decisions: DataFrame
    lost: DataFrame


def decide(tasks: DataFrame, keys: DataFrame, log: DataFrame, lease_ms: int = 30_000, delay_ms: int = 1_000) -> DataFrame:
    """(seq, key, id, decision, task_id, cancels, now_ms) of each submission of the log, in order with its commands.

    decision: insert, return, reject or invalid (no id, no time, an unknown strategy, under one attempt, a negative delay). task_id: the task that the submission ends
    up with. cancels: the task that replace puts out. A key whose task is gone is free; a null key has no conflicts. A key's submissions, and the commands to its
    present task, stream through one task of the cluster, as they must.
    """
    submits = log.where(F.col("op") == SUBMIT)
    known = F.coalesce(F.col("conflict").isin(*CONFLICTS) | F.col("key").isNull(), F.lit(False))
    in_bounds = (F.coalesce("max_attempts", F.lit(1)) >= 1) & (F.coalesce("start_delay_ms", F.lit(0)) >= 0)
    valid = F.col("id").isNotNull() & F.col("now_ms").isNotNull() & known & in_bounds
    submits = _with(submits, SUBMISSION).withColumn("valid", valid)
    seq_type = log.schema["seq"].dataType
    none = F.lit(None)
    owners = keys.select(F.col("task_id").alias("id"), "key").unionByName(submits.where("valid and key is not null").select("id", "key"))
    others = log.where(F.coalesce(F.col("op") != SUBMIT, F.lit(True)) & F.col("id").isNotNull())
    asked = others.select("id", "seq", _given(others).alias("c")).join(owners, "id")
    current = keys.select("key", F.col("task_id").alias("id")).join(tasks, "id").join(submits.select("key").distinct(), "key", "left_semi")
    columns = {"key": "string", "seq": seq_type, "id": "string", "conflict": "string", "attempts": "int", "wait": "bigint", "s": _type(STATE), "c": _type(ARGUMENTS)}
    starts = current.select("key", none.alias("seq"), "id", none.alias("conflict"), none.alias("attempts"), none.alias("wait"), _state().alias("s"), none.alias("c"))
    when = F.struct(*[(F.col("now_ms") if k == "now_ms" else F.lit(SUBMIT) if k == "op" else none).cast(t).alias(k) for k, t in ARGUMENTS.items()])
    given = F.coalesce("max_attempts", F.lit(3)).alias("attempts"), F.coalesce("start_delay_ms", F.lit(0)).alias("wait")
    keyed = submits.where("valid and key is not null").select("key", "seq", "id", "conflict", *given, none.alias("s"), when.alias("c"))
    rows = asked.select("key", "seq", "id", none.alias("conflict"), none.alias("attempts"), none.alias("wait"), none.alias("s"), "c")

    def typed(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(k).cast(t).alias(k) for k, t in columns.items()])

    every = typed(starts).unionByName(typed(keyed)).unionByName(typed(rows))
    out = StructType([*StructType.fromDDL("key string, id string, decision string, task_id string, cancels string, now_ms long").fields]).add("seq", seq_type)
    schema = to_arrow_schema(out)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now_id, s = None, None, None
        for batch in batches:
            done = []
            for place, (key, id_, conflict, attempts, wait, start, c) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("key", "id", "conflict", "attempts", "wait", "s", "c")))):
                if key != at:
                    at, now_id, s = key, None, None
                if start is not None:
                    now_id, s = id_, start
                elif conflict is None:
                    if id_ == now_id:
                        step(s, c, lease_ms, delay_ms)
                else:
                    active = s is not None and s["status"] in (QUEUED, RUNNING)
                    stays = {"reuse": active, "reuse-succeeded": active or s is not None and s["status"] == SUCCEEDED, "reject": s is not None, "replace": False}[conflict]
                    if stays:
                        done.append((place, key, id_, "reject" if conflict == "reject" else "return", None if conflict == "reject" else now_id, None, c["now_ms"]))
                    else:
                        done.append((place, key, id_, "insert", id_, now_id if active and conflict == "replace" else None, c["now_ms"]))
                        now_id, s = id_, new_state(c["now_ms"], attempts, wait)
            seqs = batch.column("seq").take(pa.array([d[0] for d in done], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[pa.array([d[i] for d in done], f.type) for i, f in zip(range(1, 7), schema)], seqs.cast(schema.field("seq").type)], schema=schema)

    in_order = every.repartition("key").sortWithinPartitions("key", F.col("seq").asc_nulls_first(), F.col("s").isNull())
    found = in_order.mapInArrow(walk, out)
    decision = F.when(F.col("valid"), "insert").otherwise(INVALID).alias("decision")
    task_id = F.when(F.col("valid"), F.col("id")).alias("task_id")
    rest = submits.where("not valid or key is null").select("key", "id", decision, task_id, none.cast("string").alias("cancels"), F.col("now_ms").cast("long").alias("now_ms"), "seq")
    return found.unionByName(rest).select("seq", "key", "id", "decision", "task_id", "cancels", "now_ms")


def new_state(now: int, max_attempts: int, wait: int) -> dict:
    """A task's state when it is put in."""
    return dict.fromkeys(STATE) | {"status": QUEUED, "attempt": 0, "max_attempts": max_attempts, "run_at_ms": now + wait, "updated_at_ms": now, "applied": 0, "lost": 0}


def _with(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return rows.withColumns({k: (F.col(k) if k in rows.columns else F.lit(None)).cast(t) for k, t in columns.items()})


def fold_log(tasks: DataFrame, keys: DataFrame, log: DataFrame, lease_ms: int = 30_000, delay_ms: int = 1_000) -> Folded:
    """A log (seq, id, op, and some of ARGUMENTS and SUBMISSION) of commands and submissions, folded. A seq is there once, and a submission's id is new."""
    decisions = kept(decide(tasks, keys, log, lease_ms, delay_ms))
    inserts = decisions.where("decision = 'insert'").select("id", F.col("seq").alias("born"))
    fresh = _with(log.where(F.col("op") == SUBMIT), SUBMISSION).join(inserts, "id").where(F.col("seq").eqNullSafe(F.col("born")))
    fresh = fresh.drop("delay_ms").withColumnRenamed("start_delay_ms", "delay_ms")
    new = insert_tasks(fresh.withColumns({"name": F.coalesce("name", F.lit("")), "payload": F.coalesce("payload", F.lit("{}"))}), F.col("now_ms"))
    new = new.join(inserts, "id")
    others = log.where(F.coalesce(F.col("op") != SUBMIT, F.lit(True)))
    commands = others.select("id", "seq", *[k for k in ARGUMENTS if k in others.columns])
    stops = decisions.where("cancels is not null").select(F.col("cancels").alias("id"), "seq", F.lit("cancel").alias("op"), "now_ms")
    commands = commands.unionByName(stops, allowMissingColumns=True)
    every = tasks.withColumn("born", F.lit(None).cast(log.schema["seq"].dataType)).unionByName(new.select(*tasks.columns, "born"))
    folded = kept(fold_commands(every, commands, lease_ms, delay_ms))
    touched = every.drop("born").join(folded.where("applied > 0").select("id").union(inserts.select("id")), "id", "left_semi")
    pointers = decisions.where("decision = 'insert' and key is not null").groupBy("key").agg(F.max_by("id", "seq").alias("task_id"))
    lost = folded.where("lost > 0").select("id", "lost", F.col("status").isNull().alias("unknown"))
    return Folded(apply_fold(touched, folded), pointers, decisions, lost)


def _type(columns: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{k}:{t}" for k, t in columns.items()) + ">"


def apply_fold(tasks: DataFrame, folded: DataFrame) -> DataFrame:
    """tasks with folded states in place."""
    carried = [k for k in STATE if k in tasks.columns]
    new = folded.where("status is not null").select(F.col("id"), F.struct(*carried).alias("_new"))
    rows = tasks.join(new, "id", "left")
    return rows.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in carried else F.col(c) for c in tasks.columns])

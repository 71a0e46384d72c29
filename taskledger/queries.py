"""Registered queries of the ledger operators over the task views, with the SQL that states the same result."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import documents
from .functions.expressions import backoff_window
from .operators import fold, ingest, keys as keyed, reads, schedule, settle, transitions as move
from .plans import apply_changes, read_table, read_version, write_version
from .plans.ranges import shared_folder
from .schema import LEASE_EXPIRED, TASK_COLUMNS, TASK_SCHEMA
from .sources.fixtures import NOW_EARLY, NOW_LATE, NOW_MID, commands, keyed_log as mixed_log, keyed_start, outcomes, task_keys, tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LEASE_MS, LIMIT, WORKER = 30_000, 64, "worker_new"
#: A task and a key that all scale factors have.
TASK, KEY = "task_00000000000000000000000001", "cust:1"

# --- SQL of the views

_T0 = "epoch_us(o_orderdate) // 1000"
_ID = "concat('task_', lpad(cast(o_orderkey as varchar), 26, '0'))"
_VIEWS = f"""
with t as (
  select {_ID} as id,
    case o_custkey % 4 when 0 then 'embed' when 1 then 'render' when 2 then 'summarize' else 'reindex' end as name,
    case substring(o_orderpriority, 1, 1) when '1' then 'rpc' when '2' then 'gpu' when '3' then 'jobs' else 'default' end as queue,
    st as status,
    concat('{{"order":', cast(o_orderkey as varchar), ',"cust":', cast(o_custkey as varchar), '}}') as payload,
    case when st = 'succeeded' then concat('{{"ok":true,"order":', cast(o_orderkey as varchar), '}}') end as result,
    case when st = 'failed' then '{{"type":"TaskError","code":"task_error","message":"boom","retryable":false,"details":{{}}}}' end as error,
    '{{}}' as metadata,
    case when st = 'succeeded' then cast(1.0 as double) when st in ('running', 'failed') then cast((o_orderkey % 10) / 10.0 as double) end as progress,
    case when st in ('running', 'failed') then 'half' end as message,
    case when st = 'queued' then cast(o_orderkey % 2 as int) else cast(1 + o_orderkey % 3 as int) end as attempt,
    3 as max_attempts,
    6 - cast(substring(o_orderpriority, 1, 1) as int) as priority,
    case when st in ('running', 'succeeded', 'failed') then concat('worker_', cast(o_orderkey % 16 as varchar)) end as worker_id,
    case when st = 'running' then t0 + 1000 * (o_orderkey % 60) end as lease_until_ms,
    t0 + (o_orderkey % 5) * 86400000 as run_at_ms,
    case when st = 'running' and o_orderkey % 7 = 0 then t0 + 500 end as cancel_requested_at_ms,
    cast(null as varchar) as parent_id,
    concat('task_', lpad(cast(o_orderkey - o_orderkey % 8 as varchar), 26, '0')) as root_id,
    concat('corr_', cast(o_custkey as varchar)) as correlation_id,
    t0 as created_at_ms, t0 + 60000 as updated_at_ms,
    case when st in ('succeeded', 'failed', 'canceled') then t0 + 60000 end as completed_at_ms
  from (select *, {_T0} as t0,
    case o_orderstatus when 'O' then 'queued' when 'P' then 'running'
      else case when o_orderkey % 10 = 0 then 'canceled' when o_orderkey % 10 < 4 then 'failed' else 'succeeded' end end as st
    from orders)),
k as (
  select concat('cust:', cast(o_custkey as varchar)) as key, {_ID} as task_id
  from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1),
o as (
  select {_ID} as id, concat('worker_', cast(o_orderkey % 16 as varchar)) as worker,
    concat('{{"n":', cast(o_orderkey as varchar), '}}') as result,
    case when o_orderkey % 3 = 0 then 'done' end as message,
    case when o_orderkey % 2 = 0 then cast(0.75 as double) end as progress,
    '{{"type":"ValueError","code":"handler_error","message":"bad","retryable":true,"details":{{}}}}' as error,
    o_orderkey % 4 <> 0 as retryable, 1000 * (o_orderkey % 7) as delay_ms
  from orders where o_orderkey % 10 <> 9)"""


def _sql(body: str) -> str:
    return f"{_VIEWS}\n{body}"


def _changed(source: str, **values: str) -> str:
    """SELECT of all task columns of `source`, whose tasks are named t, with some in place."""
    return "select " + ", ".join(f"{values.get(c, f't.{c}')} as {c}" for c in TASK_COLUMNS) + f" from {source}"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = _sql(sql)
        return f

    return register


def _owned(now: int) -> str:
    return f"t join o on t.id = o.id where t.status = 'running' and t.worker_id = o.worker and t.lease_until_ms > {now}"


# --- views and point reads


@query("select * from t")
def tasks_view(spark, d):
    return tasks(spark, d)


@query("select * from k")
def keys_view(spark, d):
    return task_keys(spark, d)


@query(f"select * from t where id = '{TASK}'")
def get(spark, d):
    return reads.get(tasks(spark, d), TASK)


@query(f"select id, status from t where id = '{TASK}'")
def get_status(spark, d):
    return reads.get_status(tasks(spark, d), TASK)


@query(f"select task_id from k where key = '{KEY}'")
def get_key(spark, d):
    return reads.get_key(task_keys(spark, d), KEY)


@query(f"select t.* from k join t on k.task_id = t.id where k.key = '{KEY}'")
def get_by_key(spark, d):
    return reads.get_by_key(tasks(spark, d), task_keys(spark, d), KEY)


@query(f"select t.id, t.status from k join t on k.task_id = t.id where k.key = '{KEY}'")
def get_status_by_key(spark, d):
    return reads.get_status_by_key(tasks(spark, d), task_keys(spark, d), KEY)


@query("select k.key, t.* from k join t on k.task_id = t.id")
def current_tasks(spark, d):
    return reads.current_tasks(tasks(spark, d), task_keys(spark, d))


_PAGE = "order by created_at_ms desc, id desc limit"


@query(f"select * from t where status = 'failed' {_PAGE} 100")
def list_status(spark, d):
    return reads.list_tasks(tasks(spark, d), status="failed")


@query(f"select * from t where queue = 'gpu' {_PAGE} 100")
def list_queue(spark, d):
    return reads.list_tasks(tasks(spark, d), queue="gpu")


@query(f"select * from t where name = 'embed' {_PAGE} 100")
def list_name(spark, d):
    return reads.list_tasks(tasks(spark, d), name="embed")


@query(f"select * from t where root_id = 'task_00000000000000000000000008' {_PAGE} 100")
def list_chain(spark, d):
    return reads.list_tasks(tasks(spark, d), root_id="task_00000000000000000000000008")


@query(f"select * from t where correlation_id = 'corr_7' {_PAGE} 100")
def list_correlation(spark, d):
    return reads.list_tasks(tasks(spark, d), correlation_id="corr_7")


@query(f"select * from t {_PAGE} 50 offset 200")
def list_page(spark, d):
    return reads.list_tasks(tasks(spark, d), limit=50, offset=200)


# --- claims and leases


def _claim_sql(where: str, source: str = "t", now: int = NOW_MID, limit: int = LIMIT) -> str:
    first = f"(select * from {source} where status = 'queued' and run_at_ms <= {now} and {where} order by priority desc, run_at_ms, id limit {limit}) t"
    return _changed(first, status="'running'", worker_id=f"'{WORKER}'", lease_until_ms=str(now + LEASE_MS), attempt="attempt + 1", updated_at_ms=str(now))


@query(_claim_sql("queue in ('rpc', 'gpu')"))
def claim_list(spark, d):
    return move.claim(tasks(spark, d), WORKER, NOW_MID, LEASE_MS, LIMIT, ["rpc", "gpu"])


@query(_claim_sql("queue = 'jobs'"))
def claim_one_queue(spark, d):
    return move.claim(tasks(spark, d), WORKER, NOW_MID, LEASE_MS, LIMIT, ["jobs"])


@query(_claim_sql("name = 'render'"))
def claim_one_name(spark, d):
    return move.claim(tasks(spark, d), WORKER, NOW_MID, LEASE_MS, LIMIT, names=["render"])


@query(_claim_sql("queue = 'gpu' and name = 'embed'"))
def claim_one_queue_one_name(spark, d):
    return move.claim(tasks(spark, d), WORKER, NOW_MID, LEASE_MS, LIMIT, ["gpu"], ["embed"])


@query(_claim_sql("true", now=NOW_EARLY))
def claim_not_due(spark, d):
    return move.claim(tasks(spark, d), WORKER, NOW_EARLY, LEASE_MS, LIMIT)


@query(_claim_sql("false"))
def claim_empty_names(spark, d):
    return move.claim(tasks(spark, d), WORKER, NOW_MID, LEASE_MS, LIMIT, names=[])


@query(f"select exists(select 1 from t where status = 'queued' and run_at_ms <= {NOW_MID} and queue = 'rpc') or exists(select 1 from t where status = 'running' and lease_until_ms <= {NOW_MID}) as claimable")
def claimable_probe(spark, d):
    return reads.claimable_probe(tasks(spark, d), NOW_MID, ["rpc"])


_F, _R = "t.cancel_requested_at_ms is not null", "t.cancel_requested_at_ms is null and t.attempt < t.max_attempts"
_RECOVERED = _changed(
    f"t where t.status = 'running' and t.lease_until_ms <= {NOW_MID}",
    status=f"case when {_F} then 'canceled' when {_R} then 'queued' else 'failed' end",
    error=f"case when not ({_F}) and not ({_R}) then '{LEASE_EXPIRED}' else t.error end",
    progress=f"case when {_R} then null else t.progress end",
    message=f"case when {_R} then null else t.message end",
    worker_id=f"case when {_R} then null else t.worker_id end",
    lease_until_ms="cast(null as bigint)",
    run_at_ms=f"case when {_R} then {NOW_MID} else t.run_at_ms end",
    completed_at_ms=f"case when {_R} then t.completed_at_ms else {NOW_MID} end",
    updated_at_ms=str(NOW_MID),
)


@query(_RECOVERED)
def recover_leases(spark, d):
    return move.recover_leases(tasks(spark, d), NOW_MID)


_AFTER = f", r as ({_RECOVERED}), a as (select * from t where id not in (select id from r) union all select * from r) "


@query(_AFTER + _claim_sql("queue in ('rpc', 'jobs')", "a", limit=500))
def claim_session(spark, d):
    return move.claim_session(tasks(spark, d), WORKER, NOW_MID, LEASE_MS, 500, ["rpc", "jobs"])


# --- owned writes


@query(_changed(_owned(NOW_EARLY), lease_until_ms=str(NOW_EARLY + LEASE_MS), updated_at_ms=str(NOW_EARLY)))
def heartbeat(spark, d):
    return move.heartbeat(tasks(spark, d), outcomes(spark, d).select("id", "worker"), NOW_EARLY, LEASE_MS)


@query(f"select t.id, t.cancel_requested_at_ms is not null as cancel_requested from {_owned(NOW_EARLY)}")
def heartbeat_batch(spark, d):
    return move.heartbeat_batch(tasks(spark, d), outcomes(spark, d).select("id", "worker"), NOW_EARLY, LEASE_MS)


@query(_changed(_owned(NOW_EARLY), progress="coalesce(o.progress, t.progress)", updated_at_ms=str(NOW_EARLY)))
def progress_value(spark, d):
    return move.report_progress(tasks(spark, d), outcomes(spark, d).select("id", "worker", "progress", F.lit(None).cast("string").alias("message")), NOW_EARLY)


@query(_changed(_owned(NOW_EARLY), message="coalesce(o.message, t.message)", updated_at_ms=str(NOW_EARLY)))
def progress_message(spark, d):
    return move.report_progress(tasks(spark, d), outcomes(spark, d).select("id", "worker", F.lit(None).cast("double").alias("progress"), "message"), NOW_EARLY)


_SETTLED = dict(lease_until_ms="cast(null as bigint)", completed_at_ms=str(NOW_EARLY), updated_at_ms=str(NOW_EARLY))


@query(_changed(_owned(NOW_EARLY), status="'succeeded'", result="o.result", progress="cast(1.0 as double)", message="coalesce(o.message, t.message)", **_SETTLED))
def succeed(spark, d):
    return move.succeed(tasks(spark, d), outcomes(spark, d).select("id", "worker", "result", "message"), NOW_EARLY)


@query(
    _changed(
        _owned(NOW_EARLY), status=f"case when {_F} then 'canceled' else 'succeeded' end", result=f"case when {_F} then t.result else o.result end", progress=f"case when {_F} then t.progress else cast(1.0 as double) end", **_SETTLED
    )
)
def complete(spark, d):
    return move.complete(tasks(spark, d), outcomes(spark, d).select("id", "worker", "result"), NOW_EARLY)


def _fail_sql(retryable: str) -> str:
    again = f"({_R} and {retryable})"
    return _changed(
        _owned(NOW_EARLY),
        status=f"case when {_F} then 'canceled' when {again} then 'queued' else 'failed' end",
        error="o.error",
        progress=f"case when {again} then null else t.progress end",
        message=f"case when {again} then null else t.message end",
        worker_id=f"case when {again} then null else t.worker_id end",
        lease_until_ms="cast(null as bigint)",
        run_at_ms=f"case when {again} then {NOW_EARLY} + o.delay_ms else t.run_at_ms end",
        completed_at_ms=f"case when {again} then null else {NOW_EARLY} end",
        updated_at_ms=str(NOW_EARLY),
    )


@query(_fail_sql("o.retryable"))
def fail_retryable(spark, d):
    return move.fail(tasks(spark, d), outcomes(spark, d).select("id", "worker", "error", "retryable", "delay_ms"), NOW_EARLY)


@query(_fail_sql("false"))
def fail_permanent(spark, d):
    return move.fail(tasks(spark, d), outcomes(spark, d).select("id", "worker", "error", F.lit(False).alias("retryable"), "delay_ms"), NOW_EARLY)


@query(f"select o.id, o.worker from o where not exists (select 1 from t where t.id = o.id and t.status = 'running' and t.worker_id = o.worker and t.lease_until_ms > {NOW_EARLY})")
def lost_lease(spark, d):
    return move.lost_leases(tasks(spark, d), outcomes(spark, d).select("id", "worker"), NOW_EARLY)


# --- cancel, retry, purge


@query(
    _changed(
        "t where t.status in ('queued', 'running')",
        status="case when t.status = 'queued' then 'canceled' else t.status end",
        cancel_requested_at_ms=f"case when t.status = 'queued' then t.cancel_requested_at_ms else {NOW_MID} end",
        completed_at_ms=f"case when t.status = 'queued' then {NOW_MID} else t.completed_at_ms end",
        updated_at_ms=str(NOW_MID),
    )
)
def cancel(spark, d):
    return move.cancel(tasks(spark, d), NOW_MID)


def _retry_sql(where: str, attempt: str = "t.attempt") -> str:
    empty = {c: f"cast(null as {k})" for c, k in (("error", "varchar"), ("progress", "double"), ("message", "varchar"), ("worker_id", "varchar"), ("lease_until_ms", "bigint"), ("cancel_requested_at_ms", "bigint"), ("completed_at_ms", "bigint"))}
    return _changed(f"t where t.status in ('failed', 'canceled') and {where}", status="'queued'", attempt=attempt, run_at_ms=str(NOW_MID), updated_at_ms=str(NOW_MID), **empty)


@query(_retry_sql("true"))
def retry(spark, d):
    return move.retry(tasks(spark, d), NOW_MID)


@query(_retry_sql("true", "0"))
def retry_reset(spark, d):
    return move.retry(tasks(spark, d), NOW_MID, reset_attempts=True)


@query(_retry_sql("t.id in (select task_id from k where key like 'cust:%5')"))
def retry_by_key(spark, d):
    wanted = task_keys(spark, d).where(F.col("key").like("cust:%5"))
    return move.retry(tasks(spark, d), NOW_MID, keyed.ids_of(task_keys(spark, d), wanted))


@query(
    _changed(
        "t where t.status in ('queued', 'running') and t.id in (select task_id from k where key like 'cust:%5')",
        status="case when t.status = 'queued' then 'canceled' else t.status end",
        cancel_requested_at_ms=f"case when t.status = 'queued' then t.cancel_requested_at_ms else {NOW_MID} end",
        completed_at_ms=f"case when t.status = 'queued' then {NOW_MID} else t.completed_at_ms end",
        updated_at_ms=str(NOW_MID),
    )
)
def cancel_by_key(spark, d):
    wanted = task_keys(spark, d).where(F.col("key").like("cust:%5"))
    return move.cancel(tasks(spark, d), NOW_MID, keyed.ids_of(task_keys(spark, d), wanted))


def _purge_sql(where: str = "true", now: int = NOW_MID, older: int = 86_400_000) -> str:
    return f"select id from t where status in ('succeeded', 'failed', 'canceled') and completed_at_ms < {now - older} and {where} order by completed_at_ms, id limit 1000"


@query(_purge_sql())
def purge(spark, d):
    return move.purge(tasks(spark, d), NOW_MID, 86_400_000)


@query(_purge_sql("status = 'failed'"))
def purge_status(spark, d):
    return move.purge(tasks(spark, d), NOW_MID, 86_400_000, status="failed")


@query(_purge_sql("queue = 'rpc'"))
def purge_queue(spark, d):
    return move.purge(tasks(spark, d), NOW_MID, 86_400_000, queue="rpc")


@query(_purge_sql("name = 'embed'"))
def purge_name(spark, d):
    return move.purge(tasks(spark, d), NOW_MID, 86_400_000, name="embed")


@query(f"select k.* from k where task_id in ({_purge_sql(now=NOW_LATE, older=0).replace('limit 1000', 'limit 100000')})")
def purge_cascade(spark, d):
    return move.purged_keys(task_keys(spark, d), move.purge(tasks(spark, d), NOW_LATE, 0, limit=100_000))


@query(f"select distinct id from t where status in ('succeeded', 'failed', 'canceled') and ((queue = 'rpc' and completed_at_ms < {NOW_MID - 1000}) or (queue = 'jobs' and status = 'failed' and completed_at_ms < {NOW_MID - 10**10}) or completed_at_ms < {NOW_MID - 10**11})")
def retention_rules(spark, d):
    rules = [(1000, "rpc", None, None), (10**10, "jobs", "failed", None), (10**11, None, None, None)]
    return move.purge_by_rules(tasks(spark, d), spark.createDataFrame(rules, "older_than_ms long, queue string, status string, name string"), NOW_MID)


# --- statistics

_STATUSES = "(values ('queued'), ('running'), ('succeeded'), ('failed'), ('canceled')) s(status)"


@query(f"select q.queue, s.status, count(t.id) as n from (select distinct queue from t) q cross join {_STATUSES} left join t on t.queue = q.queue and t.status = s.status group by all")
def stats(spark, d):
    return reads.stats(tasks(spark, d))


@query(f"select 'none' as queue, s.status, count(t.id) as n from {_STATUSES} left join t on t.queue = 'none' and t.status = s.status group by all")
def stats_one_queue(spark, d):
    return reads.stats(tasks(spark, d), "none")


@query("select queue, " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in ("queued", "running", "succeeded", "failed", "canceled")) + " from t group by queue")
def stats_pivot(spark, d):
    return reads.stats_wide(tasks(spark, d))


@query("select cast(2000 - count(*) as bigint) as headroom from (select 1 from t where queue = 'default' and status = 'queued' limit 2000)")
def queue_depth(spark, d):
    return reads.queue_depth(tasks(spark, d), "default", 2000)


@query("select id, name, cast((row_number() over (partition by name order by priority desc, run_at_ms, id) - 1) // case name when 'embed' then 256 when 'render' then 8 else 1 end as bigint) as chunk from t where status = 'running'")
def deliveries(spark, d):
    return reads.deliveries(tasks(spark, d).where("status = 'running'"), {"embed": 256, "render": 8})


@query(
    f"select id, name, place from (select *, row_number() over (partition by name order by priority desc, run_at_ms, id) as place from t where status = 'queued' and run_at_ms <= {NOW_MID} and name in ('embed', 'render')) where place <= case name when 'embed' then 256 else 16 end"
)
def quota_draws(spark, d):
    return reads.claim_by_quota(tasks(spark, d), {"embed": 256, "render": 16}, NOW_MID)


_DRAWN = f"""
, p as (select *, row_number() over (partition by name order by priority desc, run_at_ms, id) as place,
    case name when 'summarize' then 0 when 'embed' then 1 else 2 end as turn
  from t where status = 'queued' and run_at_ms <= {NOW_LATE} and name in ('embed', 'render', 'summarize')),
q as (select * from p where place <= case name when 'embed' then 40 when 'render' then 30 else 20 end),
b as (select turn, 50 - coalesce(sum(n) over (order by turn rows between unbounded preceding and 1 preceding), 0) as free from (select turn, count(*) as n from q group by turn))
select id, name, place from q join b using (turn) where place <= free
"""


@query(_DRAWN)
def shared_draws(spark, d):
    return reads.claim_by_budget(tasks(spark, d), {"embed": 40, "render": 30, "summarize": 20}, NOW_LATE, budget=50, start=2)


@query(
    "select id, name, bytes from (select id, name, strlen(payload) as bytes, sum(strlen(payload)) over w as s, row_number() over w as n from t where status = 'running'"
    " window w as (partition by name order by priority desc, run_at_ms, id rows between unbounded preceding and current row)) where s <= 4096 or n = 1"
)
def byte_budget(spark, d):
    return reads.within_bytes(tasks(spark, d).where("status = 'running'"), 4096)


@query(
    "select queue, share, value from (select queue, strlen(payload) as value, row_number() over (partition by queue order by strlen(payload)) as r, count(*) over (partition by queue) as n from t)"
    " cross join (select unnest([cast(0.5 as double), cast(0.95 as double)]) as share) where r = greatest(1, cast(ceil(share * n) as bigint))"
)
def payload_percentiles(spark, d):
    return reads.percentiles(tasks(spark, d).withColumn("bytes", F.octet_length("payload").cast("long")), "queue", "bytes")


@query(
    "select id, worker_id as worker, concat('{\"name\":\"', name, '\",\"bytes\":', cast(strlen(payload) as varchar), '}') as result from t where status = 'running'"
)
def batch_handler(spark, d):
    def sizes(name, rows):
        result = '{"name":"' + name + '","bytes":' + rows["payload"].str.encode("utf-8").str.len().astype(str) + "}"
        return rows[["id"]].assign(worker=rows["worker_id"], result=result)

    return move.handle(tasks(spark, d).where("status = 'running'"), {"embed": 256, "render": 8, "summarize": 64, "reindex": 64}, sizes, "id string, worker string, result string")


def _ends(call: settle.Delivery) -> object:
    """A handler that ends in every way there is, by the numbers of its tasks."""
    numbers = {id: int(id[5:]) for id in call.ids}
    first = next(iter(numbers.values()))
    if call.name == "embed":
        for id, n in numbers.items():
            if n % 5 == 0:
                call.succeed(id, {"early": n}, "early")
                call.fail(id, "too late")
            elif n % 5 == 1:
                call.fail(id, "no source", retryable=False)
        return {id: {"n": n} for id, n in numbers.items() if n % 5 < 3}
    if call.name == "render":
        if first % 3 == 0:
            raise ValueError("bad batch")
        if first % 3 == 1:
            raise settle.LostLease
        return ["no mapping"]
    if call.name == "summarize":
        if first % 4 == 1:
            raise settle.TaskError("bad input", code="bad_input")
        if first % 4 == 2:
            raise settle.TaskError("come again", retryable=True)
        return {"n": first} if first % 4 else float("nan")
    if first % 997 == 1:
        time.sleep(60)
    if first % 3 == 0:
        raise LookupError("gone")
    return first


def _envelope_sql(type: str, code: str, message: str, retryable: bool) -> str:
    return "'" + documents.envelope(type, code, message, retryable) + "'"


_ENDS = f"""
, r as (select *, cast(substr(id, 6) as bigint) as n, (row_number() over (partition by name order by priority desc, run_at_ms, id) - 1) // 8 as chunk from t where status = 'running'),
f as (select *, first_value(n) over (partition by name, chunk order by priority desc, run_at_ms, id) as head from r),
e as (
  select *, case name
      when 'embed' then case n % 5 when 0 then 'succeed' when 1 then 'fail' else 'complete' end
      when 'render' then case head % 3 when 0 then 'fail' when 1 then 'lost' else 'complete' end
      when 'summarize' then case when n % 4 = 3 then 'complete' else 'fail' end
      else case when n % 997 = 1 or n % 3 = 0 then 'fail' else 'complete' end end as kind,
    case name when 'embed' then case n % 5 when 0 then concat('{{"early":', cast(n as varchar), '}}') when 2 then concat('{{"n":', cast(n as varchar), '}}') end
      when 'summarize' then concat('{{"n":', cast(n as varchar), '}}') when 'reindex' then cast(n as varchar) end as new_result,
    case name when 'embed' then {_envelope_sql("TaskError", "task_error", "no source", False)}
      when 'render' then {_envelope_sql("ValueError", "handler_error", "bad batch", True)}
      when 'summarize' then case n % 4 when 0 then '{settle.UNSERIALIZABLE.replace("'", "''")}' when 1 then {_envelope_sql("TaskError", "bad_input", "bad input", False)} else {_envelope_sql("TaskError", "task_error", "come again", True)} end
      else case when n % 997 = 1 then {_envelope_sql("HandlerTimeout", "handler_timeout", "a call of reindex ran longer than 2000 ms", True)} else {_envelope_sql("LookupError", "handler_error", "gone", True)} end end as new_error,
    name = 'render' or name = 'reindex' or name = 'summarize' and n % 4 = 2 as retryable,
    least(30000, 1000 * cast(pow(2, greatest(0, attempt - 1)) as bigint)) as wide
  from f where lease_until_ms > {NOW_EARLY}),
x as (
  select *, case when kind = 'succeed' or kind = 'complete' and cancel_requested_at_ms is null then 'done' when cancel_requested_at_ms is not null then 'stopped' when retryable and attempt < max_attempts then 'again' else 'gone' end as became
  from e where kind <> 'lost') """


@query(
    _ENDS
    + _changed(
        "x t",
        status="case t.became when 'done' then 'succeeded' when 'stopped' then 'canceled' when 'again' then 'queued' else 'failed' end",
        result="case when t.became = 'done' then t.new_result else t.result end",
        error="case when t.kind = 'fail' then t.new_error else t.error end",
        progress="case when t.became = 'done' then 1.0 when t.became = 'again' then null else t.progress end",
        message="case when t.kind = 'succeed' then 'early' when t.became = 'again' then null else t.message end",
        worker_id="case when t.became <> 'again' then t.worker_id end",
        lease_until_ms="cast(null as bigint)",
        run_at_ms=f"case when t.became = 'again' then {NOW_EARLY} + t.wide // 2 + cast(floor(0.5 * (t.wide - t.wide // 2)) as bigint) else t.run_at_ms end",
        completed_at_ms=f"case when t.became <> 'again' then {NOW_EARLY} end",
        updated_at_ms=str(NOW_EARLY),
    )
)
def settlement(spark, d):
    """Every running task after a call of its handler, whatever became of the call."""
    rows = tasks(spark, d)
    ended = settle.deliver(rows.where("status = 'running'"), {"embed": 256, "render": 8}, _ends, max_run_ms=2000)
    return settle.settle(rows, ended, NOW_EARLY, random=F.lit(0.5))


@query("select id, cast(least(30000, 1000 * pow(2, greatest(0, attempt - 1))) as bigint) as window_ms from t")
def backoff(spark, d):
    return tasks(spark, d).select("id", backoff_window(F.col("attempt"), 1000, 30_000).alias("window_ms"))


@query("select name, cast(sum(strlen(payload)) as bigint) as bytes, count(*) as n from t group by name")
def payload_bytes(spark, d):
    return reads.payload_sizes(tasks(spark, d))


@query(f"select queue, count(*) as n, {NOW_MID} - min(run_at_ms) as oldest_ms from t where status = 'queued' and run_at_ms <= {NOW_MID} group by queue")
def backlog_age(spark, d):
    return reads.backlog_age(tasks(spark, d), NOW_MID)


@query("select status, attempt, count(*) as n from t group by status, attempt")
def attempts_histogram(spark, d):
    return reads.attempts_histogram(tasks(spark, d))


# --- keys



def submissions(spark: SparkSession, d: str) -> DataFrame:
    """(seq, key, new_id): line items as submissions under the key of their part's number, in an order without ties."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("cust:"), F.col("l_partkey").cast("string")).alias("key"), *[F.col(c).alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])
    seq = F.struct(*[c for c in rows.columns if c != "key"])
    return rows.select("key", seq.alias("seq")).withColumn("new_id", _new_id(F.col("seq")))


def _new_id(seq: Column) -> Column:
    return F.concat_ws("-", F.lit("new"), *[seq[c].cast("decimal(18,2)").cast("string") for c in _SEQ.split(", ")])


_SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_NEW_ID = "concat_ws('-', 'new', " + ", ".join(f"cast(cast({c} as decimal(18,2)) as varchar)" for c in _SEQ.split(", ")) + ")"
_DECIDED = f"""
, s as (select concat('cust:', cast(l_partkey as varchar)) as key, {_NEW_ID} as new_id, {_SEQ} from lineitem),
c as (select k.key, t.id as cur, t.status as cur_status from k join t on t.id = k.task_id),
n as (select s.key, s.new_id, c.cur, c.cur_status, row_number() over w as rn, lag(new_id) over w as prev, first_value(new_id) over w as head
  from s left join c on c.key = s.key window w as (partition by s.key order by {_SEQ}))
"""


def _decided_sql(stays: str, repeat: str) -> str:
    found = f"case when {stays} then cur else head end"
    decision = f"case when rn = 1 and not ({stays}) then 'insert' else '{repeat}' end"
    to = found if repeat == "return" else f"case when {decision} = 'insert' then new_id end"
    return f"{_DECIDED} select key, new_id, {decision} as decision, {to} as task_id, cast(null as varchar) as cancels from n"


def _submitted(spark: SparkSession, d: str, conflict: str) -> DataFrame:
    return keyed.resolve(submissions(spark, d), task_keys(spark, d), tasks(spark, d), conflict, _new_id).drop("seq")


@query(
    f"select t.id, t.name, l.l_linenumber as line, l.l_quantity as quantity, o.result from lineitem l join t on t.id = concat('task_', lpad(cast(l.l_orderkey as varchar), 26, '0')) join o on o.id = t.id"
    f" where t.status = 'running' and t.worker_id = o.worker and t.lease_until_ms > {NOW_EARLY} and t.cancel_requested_at_ms is null"
)
def complete_in(spark, d):
    """Line items as a caller's own rows, written in one version with the completion of their order's task, and read back with it."""
    root = f"{shared_folder(spark)}/ledger-{uuid.uuid4()}"
    rows = tasks(spark, d)
    write_version(rows, root, 0)
    own = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("task_"), F.lpad(F.col("l_orderkey").cast("string"), 26, "0")).alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    settle.complete_in(rows, outcomes(spark, d).select("id", "worker", "result"), {"lines": own}, root, 1, NOW_EARLY)
    lines = read_table(spark, root, 1, "lines", own.schema)
    return lines.join(read_version(spark, root, 1, TASK_SCHEMA).where("status = 'succeeded'").select("id", "name", "result"), "id").select("id", "name", "line", "quantity", "result")


def _admitted_sql(limit: str) -> str:
    return f"""
, a as (select case l_suppkey % 7 when 0 then 'rpc' when 1 then 'gpu' when 2 then 'new' else 'default' end as queue, {_NEW_ID} as id, {_SEQ} from lineitem),
d as (select queue, count(*) as depth from t where status = 'queued' group by queue),
p as (select a.queue, id, row_number() over (partition by a.queue order by {_SEQ}) - 1 as place, coalesce(depth, 0) as depth from a left join d on d.queue = a.queue)
select queue, id, place, coalesce(place + depth < {limit}, true) as admitted from p"""


def _admitted(spark: SparkSession, d: str, limits: int | dict[str, int]) -> DataFrame:
    queue = F.expr("case seq.l_suppkey % 7 when 0 then 'rpc' when 1 then 'gpu' when 2 then 'new' when 3 then null else 'default' end")
    arrivals = submissions(spark, d).select(queue.alias("queue"), F.col("new_id").alias("id"), *[F.col(f"seq.{c}").alias(c) for c in _SEQ.split(", ")])
    return reads.admitted(arrivals, tasks(spark, d), limits, _SEQ.split(", ")).select("queue", "id", "place", "admitted")


@query(_admitted_sql("case p.queue when 'rpc' then 5000 when 'gpu' then 900000 when 'new' then 40 end"))
def admission(spark, d):
    """Line items that arrive at queues with limits of their own, one without."""
    return _admitted(spark, d, {"rpc": 5000, "gpu": 900_000, "new": 40})


@query(_admitted_sql("6000"))
def admission_one_limit(spark, d):
    return _admitted(spark, d, 6000)


@query(_decided_sql("coalesce(cur_status in ('queued', 'running'), false)", "return"))
def submit_reuse(spark, d):
    return _submitted(spark, d, "reuse")


@query(_decided_sql("coalesce(cur_status in ('queued', 'running', 'succeeded'), false)", "return"))
def submit_reuse_succeeded(spark, d):
    return _submitted(spark, d, "reuse-succeeded")


@query(_decided_sql("cur is not null", "reject"))
def submit_reject(spark, d):
    return _submitted(spark, d, "reject")


@query(f"{_DECIDED} select key, new_id, 'insert' as decision, new_id as task_id, case when rn > 1 then prev when cur_status in ('queued', 'running') then cur end as cancels from n")
def submit_replace(spark, d):
    return _submitted(spark, d, "replace")


_INSERTED = dict(
    id="t.new_id", name="'embed'", queue="'default'", status="'queued'", payload="'{}'", result="cast(null as varchar)", error="cast(null as varchar)", metadata="'{}'", progress="cast(null as double)", message="cast(null as varchar)", attempt="0",
    max_attempts="3", priority="0", worker_id="cast(null as varchar)", lease_until_ms="cast(null as bigint)", run_at_ms=str(NOW_MID), cancel_requested_at_ms="cast(null as bigint)", parent_id="cast(null as varchar)", root_id="t.new_id",
    correlation_id="cast(null as varchar)", created_at_ms=str(NOW_MID), updated_at_ms=str(NOW_MID), completed_at_ms="cast(null as bigint)",
)


@query(f", t2 as (select {_NEW_ID} as new_id from lineitem) " + _changed("t2 t", **_INSERTED))
def submit_insert(spark, d):
    rows = submissions(spark, d).select(F.col("new_id").alias("id"), F.lit("embed").alias("name"), F.lit("{}").alias("payload"))
    return move.insert_tasks(rows, NOW_MID)


_STOPPED = "select case when rn > 1 then prev when cur_status in ('queued', 'running') then cur end as id from n"


@query(
    f"{_DECIDED}, x as ({_STOPPED}), "
    "i as (select new_id as id, 'queued' as status, cast(null as bigint) as asked, cast(null as bigint) as ended from n union all select id, status, cancel_requested_at_ms, completed_at_ms from t where id in (select id from x)) "
    f"select id, case when stopped and status = 'queued' then 'canceled' else status end as status, case when stopped and status = 'running' then {NOW_MID} else asked end as cancel_requested_at_ms, "
    f"case when stopped and status = 'queued' then {NOW_MID} else ended end as completed_at_ms, {NOW_MID} as updated_at_ms from (select *, id in (select id from x where id is not null) as stopped from i)"
)
def submit(spark, d):
    """All submissions under replace, as one operation: every new task and every one that is put out."""
    rows = submissions(spark, d).select("seq", "key", F.lit("embed").alias("name"), F.lit("{}").alias("payload"))
    changes = keyed.submit(rows, task_keys(spark, d), tasks(spark, d), NOW_MID, "replace", _new_id).changes
    return changes.select("id", "status", "cancel_requested_at_ms", "completed_at_ms", "updated_at_ms")


@query(f"{_DECIDED} select key, last(new_id order by rn) as task_id from n group by key")
def submit_pointers(spark, d):
    rows = submissions(spark, d).select("seq", "key", F.lit("embed").alias("name"), F.lit("{}").alias("payload"))
    return keyed.submit(rows, task_keys(spark, d), tasks(spark, d), NOW_MID, "replace", _new_id).pointers


_CHILD = _INSERTED | dict(id="concat(t.id, '/', cast(t.n as varchar))", name="case t.n when 0 then 'embed' else 'render' end", parent_id="t.id", root_id="t.root_id", correlation_id="t.correlation_id")


@query(", c as (select *, unnest([0, 1]) as n from t where status = 'succeeded') " + _changed("c t", **_CHILD))
def spawn(spark, d):
    child = [F.struct(F.concat_ws("/", "id", F.lit(str(n))).alias("id"), F.lit(name).alias("name"), F.lit("{}").alias("payload")) for n, name in enumerate(("embed", "render"))]
    children = tasks(spark, d).where("status = 'succeeded'").select(F.col("id").alias("parent_id"), F.array(*child).alias("children"))
    return move.spawn(tasks(spark, d), children, NOW_MID)


@query(
    f"select coalesce(p.key, k.key) as key, coalesce(p.task_id, k.task_id) as task_id, coalesce(case when k.key is not null then {NOW_EARLY} end, {NOW_MID}) as created_at_ms, case when p.key is not null then {NOW_MID} else {NOW_EARLY} end as updated_at_ms"
    " from k full join (select concat('cust:', cast(c_custkey as varchar)) as key, concat('new_', cast(c_custkey as varchar)) as task_id from customer where c_custkey % 3 = 0) p on p.key = k.key"
)
def upsert_key(spark, d):
    keys = task_keys(spark, d).withColumns({"created_at_ms": F.lit(NOW_EARLY).cast("long"), "updated_at_ms": F.lit(NOW_EARLY).cast("long")})
    new = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 3 = 0").selectExpr("concat('cust:', cast(c_custkey as string)) as key", "concat('new_', cast(c_custkey as string)) as task_id")
    return keyed.upsert_keys(keys, new, NOW_MID)


# --- versions and folds


_RULES = [(1000, "rpc", None, None, 300), (10**10, "jobs", "failed", None, 50), (1000, None, "failed", "embed", 200), (10**11, None, None, None, None)]


@query(
    ", rules as (select * from (values "
    + ", ".join(f"({n}, {older}, {', '.join('null' if x is None else repr(x) for x in rest)})" for n, (older, *rest) in enumerate(_RULES))
    + f") v(rule, older, q, s, nm, most)), m as (select id, rule, most, row_number() over (partition by rule order by completed_at_ms, id) as n from t join rules on status in ('succeeded', 'failed', 'canceled') and completed_at_ms < {NOW_MID} - older and (q is null or q = queue) and (s is null or s = status) and (nm is null or nm = name))"
    " select distinct id from m where most is null or n <= most"
)
def retention_limits(spark, d):
    """What overlapping rules with limits of their own let go."""
    rules = spark.createDataFrame(_RULES, "older_than_ms long, queue string, status string, name string, limit int")
    return move.purge_by_rules(tasks(spark, d), rules, NOW_MID)


_HANDLERS = {"embed": dict(batch=16, concurrency=40, resource="gpu"), "render": dict(batch=8, resource="gpu"), "summarize": {}, "reindex": {}}
_FREE, _GPU, _CLAIM_BATCH = 60, 45, 512


@query(
    f"""
, s(turn, draw, batch, conc, gpu) as (values (0, 1, 8, null, true), (1, 2, 1, null, false), (2, 0, 16, 40, true)),
due as (select id, name, case name when 'embed' then 0 when 'render' then 1 else 2 end as draw, priority, run_at_ms from t where status = 'queued' and run_at_ms <= {NOW_MID}),
run as (select case name when 'embed' then 0 when 'render' then 1 else 2 end as draw, count(*) as n from t where status = 'running' and worker_id = 'worker_3' group by 1),
x as (
  select s.*, (select count(*) from due where due.draw = s.draw) as n, coalesce((select n from run where run.draw = s.draw), 0) as busy from s),
y as (select *, cast(ceil(n / batch) as bigint) as want, cast(ceil(busy / batch) as bigint) as flying from x),
r as (
  with recursive r as (
    select cast(0 as bigint) as turn, cast({_FREE} as bigint) as left_, cast(greatest(0, {_GPU} - (select coalesce(sum(flying), 0) from y where gpu)) as bigint) as room, cast(null as int) as draw, cast(0 as bigint) as calls
    union all
    select r.turn + 1, left_ - c, room - case when gpu then c else 0 end, draw_, c from (
      select r.turn, r.left_, r.room, y.gpu, y.draw as draw_, greatest(0, least(r.left_, y.want, greatest(1, {_CLAIM_BATCH} // y.batch), case when y.conc is null then {_FREE} else greatest(0, y.conc - y.flying) end, case when y.gpu then r.room else {_FREE} end)) as c
      from r join y on y.turn = r.turn) r)
  select * from r),
p as (select id, name, draw, (row_number() over (partition by draw order by priority desc, run_at_ms, id) - 1) // (select batch from s where s.draw = due.draw) as call from due)
select p.id, p.name, p.draw, cast(p.call as bigint) as call from p join r on r.draw = p.draw where p.call < r.calls"""
)
def joint_ceilings(spark, d):
    """What a worker draws for names of which two share a resource, from the second draw on."""
    return schedule.claim_by_ceilings(tasks(spark, d), schedule.draws_of(_HANDLERS), "worker_3", NOW_MID, _FREE, {"gpu": _GPU}, start=1, claim_batch=_CLAIM_BATCH)


_DOCUMENTS = ['{"a":1}', " [1, 2.50]", '{"a":NaN}', "{bad", '"x"', "", '{"k":"\u00e9", "k2":[]}']


@query(
    ", p as (select list_value(" + ", ".join("'" + x + "'" for x in _DOCUMENTS) + f") as docs), l as (select {_NEW_ID} as id, case when l_suppkey % 11 = 0 then '' else 'embed' end as name, docs[l_linenumber % 7 + 1] as payload, case l_partkey % 5 when 0 then '[]' when 1 then null else '{{}}' end as metadata,"
    " cast(l_suppkey % 4 as int) as max_attempts, l_partkey % 13 - 1 as delay_ms from lineitem, p)"
    " select id, payload, case when name = '' then 'name' when not json_valid(payload) or payload like '%NaN%' then 'payload' when metadata = '[]' then 'metadata_object' when max_attempts < 1 then 'max_attempts' when delay_ms < 0 then 'delay_ms' end as reason from l"
)
def ingest_split(spark, d):
    """Line items as submissions, good and bad, each with the reason why it is set aside, or none."""
    rows = submissions(spark, d).select(
        F.col("new_id").alias("id"), F.expr("if(seq.l_suppkey % 11 = 0, '', 'embed')").alias("name"), F.element_at(F.array(*map(F.lit, _DOCUMENTS)), (F.col("seq.l_linenumber") % 7 + 1).cast("int")).alias("payload"),
        F.expr("case seq.l_partkey % 5 when 0 then '[]' when 1 then null else '{}' end").alias("metadata"), F.expr("cast(seq.l_suppkey % 4 as int)").alias("max_attempts"), F.expr("seq.l_partkey % 13 - 1").alias("delay_ms"),
    )
    split = ingest.ingest(rows)
    return split.valid.select("id", "payload", F.lit(None).cast("string").alias("reason")).unionByName(split.quarantined.select("id", "payload", "reason"))


@query(f", r as ({_RECOVERED}) select status, count(*) as n, cast(sum(updated_at_ms) as bigint) as updated from (select * from t where id not in (select id from r) union all select * from r) group by status")
def next_version(spark, d):
    rows = tasks(spark, d)
    return apply_changes(rows, move.recover_leases(rows, NOW_MID)).groupBy("status").agg(F.count("*").alias("n"), F.sum("updated_at_ms").alias("updated"))


@query(f", r as ({_RECOVERED}) select case when status = 'queued' then 'queued' else 'done' end as reason, queue, id from r")
def change_feed(spark, d):
    rows = tasks(spark, d)
    return reads.change_feed(rows, apply_changes(rows, move.recover_leases(rows, NOW_MID)))


_FOLD = f"""
with recursive c as (
  select concat('user_', cast(user_id as varchar)) as id, row_number() over (partition by user_id order by ts, event_id) as seq, epoch_us(ts) // 1000 as now,
    case event_type when 'view' then case when event_id % 2 = 0 then 'heartbeat' else 'progress' end when 'click' then 'claim'
      when 'purchase' then case when event_id % 3 = 0 then 'succeed' else 'complete' end when 'error' then 'fail'
      else case event_id % 3 when 0 then 'cancel' when 1 then 'retry' else 'expire' end end as op,
    case when event_id % 5 = 0 then 'worker_b' else 'worker_a' end as worker, event_id % 4 / cast(4 as double) as new_progress, concat('m', cast(event_id % 5 as varchar)) as new_message,
    concat('{{"event":', cast(event_id as varchar), '}}') as new_result, concat('{{"code":', cast(event_id % 3 as varchar), '}}') as new_error, event_id % 3 <> 0 as retryable, 1000 * (event_id % 2) as delay_ms
  from events),
f as (
  select distinct id, cast(0 as bigint) as n, 'queued' as status, cast(null as varchar) as result, cast(null as varchar) as error, cast(null as double) as progress, cast(null as varchar) as message, 0 as attempt, 3 as max_attempts,
    cast(null as varchar) as worker_id, cast(null as bigint) as lease_until_ms, cast(0 as bigint) as run_at_ms, cast(null as bigint) as cancel_requested_at_ms, cast(null as bigint) as completed_at_ms, cast(0 as bigint) as updated_at_ms,
    cast(0 as bigint) as applied, cast(0 as bigint) as lost
  from c
  union all
  select id, n + 1,
    case kind when 'claim' then 'running' when 'done' then 'succeeded' when 'again' then 'queued' when 'retry' then 'queued' when 'stop' then 'canceled' when 'drop' then 'canceled' when 'gone' then 'failed' else status end,
    case kind when 'done' then new_result else result end,
    case when kind in ('again', 'stop', 'gone') and op = 'fail' then new_error when kind = 'gone' then '{LEASE_EXPIRED}' when kind = 'retry' then null else error end,
    case kind when 'progress' then new_progress when 'done' then 1.0 when 'again' then null when 'retry' then null else progress end,
    case when kind = 'progress' or kind = 'done' and op = 'succeed' then new_message when kind in ('again', 'retry') then null else message end,
    case kind when 'claim' then attempt + 1 else attempt end, max_attempts,
    case kind when 'claim' then worker when 'again' then null when 'retry' then null else worker_id end,
    case when kind in ('claim', 'beat') then now + 86400000 when kind in ('done', 'stop', 'gone', 'again', 'retry') then null else lease_until_ms end,
    case when kind = 'again' and op = 'fail' then now + delay_ms when kind in ('again', 'retry') then now else run_at_ms end,
    case kind when 'ask' then now when 'retry' then null else cancel_requested_at_ms end,
    case when kind in ('done', 'stop', 'gone', 'drop') then now when kind = 'retry' or kind = 'again' and op = 'fail' then null else completed_at_ms end,
    case when kind in ('none', 'lost') then updated_at_ms else now end, applied + case when kind in ('none', 'lost') then 0 else 1 end, lost + case when kind = 'lost' then 1 else 0 end
  from (
    select *, case
      when op in ('heartbeat', 'progress', 'complete', 'succeed', 'fail') and not holds then 'lost'
      when op = 'claim' then case when status = 'queued' and run_at_ms <= now then 'claim' else 'none' end
      when op = 'heartbeat' then 'beat' when op = 'progress' then 'progress' when op = 'succeed' then 'done'
      when op = 'complete' then case when asked then 'stop' else 'done' end
      when op = 'fail' then case when asked then 'stop' when retryable and attempt < max_attempts then 'again' else 'gone' end
      when op = 'expire' then case when status <> 'running' or lease_until_ms > now then 'none' when asked then 'stop' when attempt < max_attempts then 'again' else 'gone' end
      when op = 'cancel' then case status when 'queued' then 'drop' when 'running' then 'ask' else 'none' end
      else case when status in ('failed', 'canceled') then 'retry' else 'none' end end as kind
    from (select f.*, c.* exclude (id, seq), coalesce(status = 'running' and worker_id = worker and lease_until_ms > now, false) as holds, cancel_requested_at_ms is not null as asked from f join c on c.id = f.id and c.seq = f.n + 1)))
select f.* exclude (n) from f join (select id, max(seq) as last from c group by id) m on f.id = m.id and f.n = m.last
"""


@query(None)
def command_fold(spark, d):
    log = commands(spark, d)
    empty = [f"cast(null as {k}) as {c}" for c, k in (("result", "string"), ("error", "string"), ("progress", "double"), ("message", "string"), ("worker_id", "string"), ("lease_until_ms", "bigint"), ("cancel_requested_at_ms", "bigint"), ("completed_at_ms", "bigint"))]
    start = log.select("id").distinct().selectExpr("id", "'queued' as status", "0 as attempt", "3 as max_attempts", "0L as run_at_ms", "0L as updated_at_ms", *empty)
    return fold.fold_commands(start, log, lease_ms=86_400_000)


ORACLE_SQL["command_fold"] = _FOLD


def _recursion(name: str, log: str, start: str, numbers: str, states: str) -> str:
    """CTEs that fold `log` (grp, seq, ...) by grp from `start` (grp, cur, status, ...): `name` has the state after each row, what the row did, and what was before. Rows to a `target` other than the present task do nothing."""
    null = "cast(null as {0}) as {1}".format
    fields = [null("varchar", "result"), null("varchar", "error"), null("double", "progress"), null("varchar", "message"), "0 as attempt", "3 as max_attempts", null("varchar", "worker_id"), null("bigint", "lease_until_ms"), "cast(0 as bigint) as run_at_ms"]
    fields += [null("bigint", "cancel_requested_at_ms"), null("bigint", "completed_at_ms"), "cast(0 as bigint) as updated_at_ms", "cast(0 as bigint) as applied", "cast(0 as bigint) as lost"]
    return f"""
{numbers} as (select *, row_number() over (partition by grp order by seq) as rn from {log}),
{name} as (
  select grp, cast(0 as bigint) as n, cur, status, {", ".join(fields)}, cast(null as varchar) as did, cast(null as varchar) as was, false as active, cast(null as bigint) as at_seq, cast(null as bigint) as at_now, cast(null as varchar) as new_task from ({start})
  union all
  select grp, n + 1, case when kind = 'insert' then own_task else cur end,
    case kind when 'insert' then 'queued' when 'claim' then 'running' when 'done' then 'succeeded' when 'again' then 'queued' when 'retry' then 'queued' when 'stop' then 'canceled' when 'drop' then 'canceled' when 'gone' then 'failed' else status end,
    case kind when 'insert' then null when 'done' then new_result else result end,
    case when kind = 'insert' then null when kind in ('again', 'stop', 'gone') and op = 'fail' then new_error when kind = 'gone' then '{LEASE_EXPIRED}' when kind = 'retry' then null else error end,
    case kind when 'progress' then new_progress when 'done' then 1.0 when 'again' then null when 'retry' then null when 'insert' then null else progress end,
    case when kind = 'progress' or kind = 'done' and op = 'succeed' then new_message when kind in ('again', 'retry', 'insert') then null else message end,
    case kind when 'claim' then attempt + 1 when 'insert' then 0 else attempt end, case kind when 'insert' then new_max else max_attempts end,
    case kind when 'claim' then worker when 'again' then null when 'retry' then null when 'insert' then null else worker_id end,
    case when kind in ('claim', 'beat') then now + 86400000 when kind in ('done', 'stop', 'gone', 'again', 'retry', 'insert') then null else lease_until_ms end,
    case when kind = 'insert' then now + wait when kind = 'again' and op = 'fail' then now + delay_ms when kind in ('again', 'retry') then now else run_at_ms end,
    case kind when 'ask' then now when 'retry' then null when 'insert' then null else cancel_requested_at_ms end,
    case when kind in ('done', 'stop', 'gone', 'drop') then now when kind in ('retry', 'insert') or kind = 'again' and op = 'fail' then null else completed_at_ms end,
    case when kind in ('none', 'lost') then updated_at_ms else now end, case when kind = 'insert' then 0 when kind in ('none', 'lost') then applied else applied + 1 end, lost + case when kind = 'lost' then 1 else 0 end,
    kind, cur, coalesce(status in ('queued', 'running'), false), seq, now, own_task
  from (
    select *, case
      when op = 'submit' then case when coalesce(case conflict when 'reuse' then status in ('queued', 'running') when 'reuse-succeeded' then status in ('queued', 'running', 'succeeded') when 'reject' then cur is not null else false end, false) then 'none' else 'insert' end
      when target is distinct from cur then 'none'
      when status is null then 'lost'
      when op in ('heartbeat', 'progress', 'complete', 'succeed', 'fail') and not holds then 'lost'
      when op = 'claim' then case when status = 'queued' and run_at_ms <= now then 'claim' else 'none' end
      when op = 'heartbeat' then 'beat' when op = 'progress' then 'progress' when op = 'succeed' then 'done'
      when op = 'complete' then case when asked then 'stop' else 'done' end
      when op = 'fail' then case when asked then 'stop' when retryable and attempt < max_attempts then 'again' else 'gone' end
      when op = 'expire' then case when status <> 'running' or lease_until_ms > now then 'none' when asked then 'stop' when attempt < max_attempts then 'again' else 'gone' end
      when op = 'cancel' then case status when 'queued' then 'drop' when 'running' then 'ask' else 'none' end
      else case when status in ('failed', 'canceled') then 'retry' else 'none' end end as kind
    from (select f.* exclude (did, was, active, at_seq, at_now, new_task), c.* exclude (grp), coalesce(status = 'running' and worker_id = worker and lease_until_ms > now, false) as holds, cancel_requested_at_ms is not null as asked
      from {name} f join {numbers} c on c.grp = f.grp and c.rn = f.n + 1))),
{states} as (select f.* from {name} f join (select grp, max(rn) as last from {numbers} group by grp) m on f.grp = m.grp and f.n = m.last)"""


_MIXED = f"""
with recursive ev as (
  select *, case when event_id % 6 = 0 then concat('user_', cast(user_id as varchar), '/', cast(event_id as varchar)) end as new from events),
ev2 as (select *, last_value(new ignore nulls) over w as last, row_number() over w as seq from ev window w as (partition by user_id order by ts, event_id)),
log as (
  select concat('user:', cast(user_id as varchar)) as key, seq, epoch_us(ts) // 1000 as now,
    case when event_id % 6 = 0 then new when event_id % 4 = 0 or last is null then concat('user_', cast(user_id as varchar)) else last end as id,
    case when event_id % 6 = 0 then 'submit' else case event_type when 'view' then case when event_id % 2 = 0 then 'heartbeat' else 'progress' end when 'click' then 'claim'
      when 'purchase' then case when event_id % 3 = 0 then 'succeed' else 'complete' end when 'error' then 'fail'
      else case event_id % 3 when 0 then 'cancel' when 1 then 'retry' else 'expire' end end end as op,
    case when event_id % 5 = 0 then 'worker_b' else 'worker_a' end as worker, event_id % 4 / cast(4 as double) as new_progress, concat('m', cast(event_id % 5 as varchar)) as new_message,
    concat('{{"event":', cast(event_id as varchar), '}}') as new_result, concat('{{"code":', cast(event_id % 3 as varchar), '}}') as new_error, event_id % 3 <> 0 as retryable, 1000 * (event_id % 2) as delay_ms,
    case user_id % 4 when 0 then 'reuse' when 1 then 'reuse-succeeded' when 2 then 'reject' else 'replace' end as conflict, cast(1 + event_id % 3 as int) as new_max, 1000 * (event_id % 3) as wait,
    case when event_id % 12 = 0 then 'embed' else 'render' end as name, user_id % 3 <> 0 as known, concat('user_', cast(user_id as varchar)) as first_task
  from ev2),
by_key as (select key as grp, seq, now, op, worker, new_progress, new_message, new_result, new_error, retryable, delay_ms, conflict, new_max, wait, id as own_task, id as target from log),
{_recursion("k1", "by_key", "select distinct key as grp, case when known then first_task end as cur, case when known then 'queued' end as status from log", "k0", "k2")},
made as (select new_task as id, at_seq as seq, at_now as now from k1 where did = 'insert'),
put_out as (select was as id, at_seq as seq, at_now as now from k1 where did = 'insert' and active and grp in (select key from log where conflict = 'replace')),
by_id as (
  select id as grp, seq, now, op, worker, new_progress, new_message, new_result, new_error, retryable, delay_ms, 'always' as conflict, new_max, wait, id as own_task, id as target from log where op <> 'submit' or id in (select id from made)
  union all select id, seq, now, 'cancel', null, null, null, null, null, null, null, null, null, null, null, id from put_out),
{_recursion("i1", "by_id", "select grp, grp as cur, max(case when grp in (select first_task from log where known) then 'queued' end) as status from by_id group by grp", "i0", "i2")}
"""
_MIXED_STATE = ["status", "result", "error", "progress", "message", "attempt", "max_attempts", "worker_id", "lease_until_ms", "run_at_ms", "cancel_requested_at_ms", "completed_at_ms", "updated_at_ms"]


def _mixed(spark: SparkSession, d: str) -> fold.Folded:
    return fold.fold_log(*keyed_start(spark, d), mixed_log(spark, d), lease_ms=86_400_000)


@query(None)
def keyed_log(spark, d):
    """Tasks that a log of commands and keyed submissions, of all four strategies, changes or puts in."""
    return _mixed(spark, d).changes.select("id", "name", "created_at_ms", *_MIXED_STATE)


ORACLE_SQL["keyed_log"] = f"""{_MIXED}
select grp as id, coalesce(log.name, 'first') as name, coalesce(log.now, 0) as created_at_ms, {", ".join(f"i2.{c}" for c in _MIXED_STATE)}
from i2 left join log on log.id = i2.grp and log.op = 'submit' where i2.status is not null and (applied > 0 or log.id is not null)"""


@query(None)
def keyed_log_decisions(spark, d):
    """What becomes of each submission of that log."""
    return _mixed(spark, d).decisions.select("key", "seq", "id", "decision", "task_id", "cancels")


ORACLE_SQL["keyed_log_decisions"] = f"""{_MIXED}
select k1.grp as key, at_seq as seq, new_task as id, case when did = 'insert' then 'insert' when conflict = 'reject' then 'reject' else 'return' end as decision,
  case when did = 'insert' then new_task when conflict <> 'reject' then was end as task_id, case when did = 'insert' and active and conflict = 'replace' then was end as cancels
from k1 join log on log.key = k1.grp and log.seq = k1.at_seq where log.op = 'submit'"""

"""Task-shaped views over the star schema, with every column of the ledger filled by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import TASK_COLUMNS, TASK_SCHEMA

#: Times at which operators run on the views: leases half over, leases alive, everything over.
NOW_MID, NOW_EARLY, NOW_LATE = 883_612_800_000, 788_918_400_000, 1_009_843_200_000

_TASKS = {
    "id": "concat('task_', lpad(cast(o_orderkey as string), 26, '0'))",
    "name": "case o_custkey % 4 when 0 then 'embed' when 1 then 'render' when 2 then 'summarize' else 'reindex' end",
    "queue": "case substring(o_orderpriority, 1, 1) when '1' then 'rpc' when '2' then 'gpu' when '3' then 'jobs' else 'default' end",
    "status": "st",
    "payload": """concat('{"order":', cast(o_orderkey as string), ',"cust":', cast(o_custkey as string), '}')""",
    "result": """case when st = 'succeeded' then concat('{"ok":true,"order":', cast(o_orderkey as string), '}') end""",
    "error": """case when st = 'failed' then '{"type":"TaskError","code":"task_error","message":"boom","retryable":false,"details":{}}' end""",
    "metadata": "'{}'",
    "progress": "case when st = 'succeeded' then 1.0D when st in ('running', 'failed') then cast((o_orderkey % 10) / 10.0D as double) end",
    "message": "case when st in ('running', 'failed') then 'half' end",
    "attempt": "case when st = 'queued' then cast(o_orderkey % 2 as int) else cast(1 + o_orderkey % 3 as int) end",
    "max_attempts": "3",
    "priority": "6 - cast(substring(o_orderpriority, 1, 1) as int)",
    "worker_id": "case when st in ('running', 'succeeded', 'failed') then concat('worker_', cast(o_orderkey % 16 as string)) end",
    "lease_until_ms": "case when st = 'running' then t0 + 1000 * (o_orderkey % 60) end",
    "run_at_ms": "t0 + (o_orderkey % 5) * 86400000",
    "cancel_requested_at_ms": "case when st = 'running' and o_orderkey % 7 = 0 then t0 + 500 end",
    "parent_id": "cast(null as string)",
    "root_id": "concat('task_', lpad(cast(o_orderkey - o_orderkey % 8 as string), 26, '0'))",
    "correlation_id": "concat('corr_', cast(o_custkey as string))",
    "created_at_ms": "t0",
    "updated_at_ms": "t0 + 60000",
    "completed_at_ms": "case when st in ('succeeded', 'failed', 'canceled') then t0 + 60000 end",
}


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each order: its status follows the order's, its times the order's date."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ended = F.when(F.col("o_orderkey") % 10 == 0, "canceled").when(F.col("o_orderkey") % 10 < 4, "failed").otherwise("succeeded")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise(ended)
    start = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")
    return orders.withColumns({"st": status, "t0": start}).selectExpr(*[f"{v} as {k}" for k, v in _TASKS.items()])


def task_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, task_id): each customer's key points to the task of their latest order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    latest = orders.withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()))).where("rn = 1")
    return latest.selectExpr("concat('cust:', cast(o_custkey as string)) as key", "concat('task_', lpad(cast(o_orderkey as string), 26, '0')) as task_id")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owned writes (id, worker, result, message, progress, error, retryable, delay_ms) for nine in ten tasks, from the worker that their number names."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 10 <> 9")
    return orders.selectExpr(
        "concat('task_', lpad(cast(o_orderkey as string), 26, '0')) as id",
        "concat('worker_', cast(o_orderkey % 16 as string)) as worker",
        """concat('{"n":', cast(o_orderkey as string), '}') as result""",
        "case when o_orderkey % 3 = 0 then 'done' end as message",
        "case when o_orderkey % 2 = 0 then 0.75D end as progress",
        """'{"type":"ValueError","code":"handler_error","message":"bad","retryable":true,"details":{}}' as error""",
        "o_orderkey % 4 <> 0 as retryable",
        "1000 * (o_orderkey % 7) as delay_ms",
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, op, worker, now_ms, and arguments): the events of each user as commands to a task of theirs."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = "case event_type when 'view' then if(event_id % 2 = 0, 'heartbeat', 'progress') when 'click' then 'claim' when 'purchase' then if(event_id % 3 = 0, 'succeed', 'complete') when 'error' then 'fail' else element_at(array('cancel', 'retry', 'expire'), cast(event_id % 3 as int) + 1) end"
    return events.selectExpr(
        "concat('user_', cast(user_id as string)) as id", "row_number() over (partition by user_id order by ts, event_id) as seq", f"{op} as op", "if(event_id % 5 = 0, 'worker_b', 'worker_a') as worker",
        "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) as now_ms", "event_id % 4 / 4.0D as progress", "concat('m', cast(event_id % 5 as string)) as message",
        """concat('{"event":', cast(event_id as string), '}') as result""", """concat('{"code":', cast(event_id % 3 as string), '}') as error""", "event_id % 3 <> 0 as retryable", "1000 * (event_id % 2) as delay_ms",
    )


def keyed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, op, and arguments of commands and submissions): every sixth event submits a task under its user's key; the others are commands to the user's first task or to the one that was last submitted before."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    base = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("new", F.expr("case when event_id % 6 = 0 then concat('user_', cast(user_id as string), '/', cast(event_id as string)) end"))
    rows = base.withColumns({"last": F.last("new", ignorenulls=True).over(own), "n": F.row_number().over(own)}).selectExpr(
        "case when event_id % 6 = 0 then new when event_id % 4 = 0 or last is null then concat('user_', cast(user_id as string)) else last end as id", "cast(n as bigint) as seq", "event_id", "user_id",
        "if(event_id % 6 = 0, 'submit', null) as submit", "element_at(array('reuse', 'reuse-succeeded', 'reject', 'replace'), cast(user_id % 4 as int) + 1) as conflict", "concat('user:', cast(user_id as string)) as key",
        "if(event_id % 12 = 0, 'embed', 'render') as name", "cast(1 + event_id % 3 as int) as max_attempts", "1000 * (event_id % 3) as start_delay_ms",
    )
    log = commands(spark, sf_dir).withColumnRenamed("id", "user").withColumn("seq", F.col("seq").cast("bigint"))
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    both = rows.withColumn("user", user).join(log, ["user", "seq"])
    return both.withColumn("op", F.coalesce("submit", "op")).drop("submit", "user", "event_id", "user_id")


def keyed_start(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tasks and keys that keyed_log() begins with: two in three users have a queued task under their key."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().where("user_id % 3 <> 0").selectExpr("concat('user_', cast(user_id as string)) as id", "concat('user:', cast(user_id as string)) as key")
    tasks_ = users.selectExpr(*[f"{_FRESH.get(c, 'null')} as {c}" for c in TASK_COLUMNS])
    keys_ = users.selectExpr("key", "id as task_id", "0L as created_at_ms", "0L as updated_at_ms")
    return tasks_.select(*[F.col(f.name).cast(f.dataType) for f in TASK_SCHEMA]), keys_


_FRESH = {"id": "id", "name": "'first'", "queue": "'default'", "status": "'queued'", "payload": "'{}'", "metadata": "'{}'", "attempt": "0", "max_attempts": "3", "priority": "0", "run_at_ms": "0", "root_id": "id", "created_at_ms": "0", "updated_at_ms": "0"}

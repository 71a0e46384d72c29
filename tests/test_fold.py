"""The command fold against the transitions applied one by one, and the stream of commands."""

import random

import pytest

from taskledger.operators import transitions as move
from taskledger.operators.fold import ARGUMENTS, COMMANDS, STATE, fold_commands
from taskledger.plans import latest_version, read_version, write_changes, write_version
from taskledger.plans.versions import CHANGES, WHOLE, ended
from taskledger.schema import LEASE_EXPIRED, TASK_COLUMNS, TASK_SCHEMA
from taskledger.sources.sqlite import SqliteSource
from taskledger.streaming.commands import COMMAND_SCHEMA, apply_stream

LEASE, DELAY = 100, 30
CARRIED = [c for c in STATE if c in TASK_COLUMNS]
BLANK = dict(name="x", queue="q", status="queued", payload="{}", metadata="{}", attempt=0, max_attempts=2, priority=0, run_at_ms=0, created_at_ms=0, updated_at_ms=0)


def logs(seed, tasks, length):
    """(id, seq, and all of ARGUMENTS): commands whose order in time is that of seq, with every argument null now and then."""
    draw, out = random.Random(seed), []
    for i in range(tasks):
        now = 0
        for n in range(length):
            now += draw.choice([0, 5, 20, 60, 150])
            op = draw.choice([*COMMANDS, "claim", "claim"])
            args = draw.choice([None, 0.25]), draw.choice([None, f"m{n}"]), draw.choice([None, f'{{"n":{n}}}']), draw.choice([None, f'{{"e":{n}}}']), draw.choice([None, True, True, False]), draw.choice([None, 7])
            out.append((f"t{i:03}", n, op, f"w{draw.random() < 0.2:d}", now, *args))
    return out


@pytest.fixture
def tasks(spark):
    def build(ids, **more):
        return spark.createDataFrame([tuple((BLANK | more | {"id": i}).get(c) for c in TASK_COLUMNS) for i in ids], TASK_SCHEMA)

    return build


def one_by_one(spark, row, log):
    """The row after each command of its log, by the operators of transitions.py, and how many had an effect."""
    applied = lost = 0
    for _, _, op, worker, now, progress, message, result, error, retryable, delay in log:
        table = spark.createDataFrame([row], TASK_SCHEMA)
        write = [(row["id"], worker, progress, message, result, error, retryable, DELAY if delay is None else delay)]
        write = spark.createDataFrame(write, "id string, worker string, progress double, message string, result string, error string, retryable boolean, delay_ms long")
        if op == "claim":
            after = move.claim(table, worker, now, LEASE, 1)
        elif op == "heartbeat":
            after = move.heartbeat(table, write, now, LEASE)
        elif op == "expire":
            after = move.recover_leases(table, now)
        elif op in ("cancel", "retry"):
            after = getattr(move, op)(table, now)
        else:
            after = {"progress": move.report_progress, "complete": move.complete, "succeed": move.succeed, "fail": move.fail}[op](table, write, now)
        found = after.collect()
        applied += len(found)
        lost += op in ("heartbeat", "progress", "complete", "succeed", "fail") and not found
        row = found[0] if found else row
    return {c: row[c] for c in CARRIED} | {"applied": applied, "lost": lost}


def folded(spark, table, log):
    return {r.id: {k: v for k, v in r.asDict().items() if k != "id"} for r in fold_commands(table, spark.createDataFrame(log, COMMAND_SCHEMA), LEASE, DELAY).collect()}


def test_fold_equals_the_transitions_one_by_one(spark, tasks):
    log = logs(1, tasks=4, length=24)
    table = tasks(sorted({c[0] for c in log}))
    got = folded(spark, table, random.Random(1).sample(log, len(log)))
    assert got == {r.id: one_by_one(spark, r, [c for c in log if c[0] == r.id]) for r in table.collect()}
    assert sum(s["applied"] for s in got.values()) > 15


def test_effects_on_error_message_and_result(spark, tasks):
    def after(*ops, **more):
        log = [("t", n, op, "w", now, *[args.get(k) for k in list(ARGUMENTS)[3:]]) for n, (op, now, args) in enumerate(ops)]
        return folded(spark, tasks(["t"], **more), log)["t"]

    run = ("claim", 0, {}), ("progress", 1, dict(progress=0.5, message="half"))
    s = after(*run, ("fail", 2, dict(error='{"a":1}')))
    assert (s["status"], s["error"], s["message"], s["progress"], s["run_at_ms"]) == ("queued", '{"a":1}', None, None, 2 + DELAY)
    s = after(*run, ("fail", 2, dict(error='{"a":1}', retryable=False)))
    assert (s["status"], s["error"], s["message"], s["worker_id"]) == ("failed", '{"a":1}', "half", "w")
    s = after(*run, ("expire", 200, {}), max_attempts=1)
    assert (s["status"], s["error"], s["message"]) == ("failed", LEASE_EXPIRED, "half")
    s = after(*run, ("succeed", 2, dict(result="{}", message="done")))
    assert (s["status"], s["result"], s["message"], s["progress"]) == ("succeeded", "{}", "done", 1.0)


def test_commands_of_unknown_tasks_are_lost_and_long_logs_stream(spark, tasks):
    log = [("gone", n, "claim", "w", n) + (None,) * 6 for n in range(3)] + [("t", 2 * n, "claim", "w", 0) + (None,) * 6 for n in range(30_000)] + [(None, 0, "claim", "w", 0) + (None,) * 6]
    got = folded(spark, tasks(["t", "idle"]), log)
    assert got["gone"]["status"] is None and got["gone"]["lost"] == 3 and got["t"]["applied"] == 1 and set(got) == {"gone", "t"}


def test_stream_applies_each_command_once(spark, tasks, tmp_path):
    log = logs(3, tasks=10, length=30)
    ids = sorted({c[0] for c in log})
    root, source, checkpoint = (str(tmp_path / n) for n in ("ledger", "log", "checkpoint"))
    write_version(tasks([*ids, "idle"]), root, 0)
    for low in (0, 10, 20):
        part = [c for c in log if low <= c[1] < low + 10] + [("unknown", low, "claim", "w", 0) + (None,) * 6]
        spark.createDataFrame(part, COMMAND_SCHEMA).coalesce(1).write.mode("append").json(source)
        if low == 10:  # a writer that died has left a folder without a mark
            spark.createDataFrame([(1,)], "x int").write.parquet(f"{root}/changes=2/class=live")
        for _ in range(2):  # the second run finds nothing new
            query = apply_stream(spark.readStream.schema(COMMAND_SCHEMA).json(source), root, checkpoint, LEASE, DELAY, compact=2)
            assert query.awaitTermination(120)
    assert latest_version(spark, root) == 3 and ended(spark, root, WHOLE) == [0, 2] and ended(spark, root, CHANGES) == [1, 2, 3]
    want = folded(spark, tasks(ids), log)
    for version in (2, 3):
        rows = {r.id: r for r in read_version(spark, root, version, TASK_SCHEMA).collect()}
        assert set(rows) == {*ids, "idle"}
    assert {i: {c: rows[i][c] for c in CARRIED} for i in ids} == {i: {c: s[c] for c in CARRIED} for i, s in want.items()}
    live = read_version(spark, root, 3, TASK_SCHEMA, "live")
    assert {r.id for r in live.collect()} == {i for i, r in rows.items() if r.status in ("queued", "running")}
    assert [r.lost for r in spark.read.parquet(f"{root}/lost=3").where("unknown").collect()] == [1]
    with pytest.raises(ValueError, match="no version"):
        read_version(spark, root, 4, TASK_SCHEMA)
    with pytest.raises(ValueError, match="already"):
        write_changes(live, root, 3)


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "tasks.db")
    with sqlite3.connect(path) as db:
        db.execute("create table tasks (id text, n integer)")
        db.executemany("insert into tasks values (?, ?)", [(f"t{i}", i) for i in range(100)])
    spark.dataSource.register(SqliteSource)
    rows = spark.read.format("sqlite").schema("id string, n long").options(path=path, table="tasks", partitions=4).load()
    assert rows.rdd.getNumPartitions() == 4 and rows.selectExpr("sum(n)").first()[0] == 4950
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = spark.read.format("sqlite").schema("id string, n long").options(path=path, table="tasks", partitions=4, filters="push").load().where("n >= 90 and n < 95 and id <> 't92' and id is not null")
        assert sorted(r.n for r in few.collect()) == [90, 91, 93, 94]
        one = spark.read.format("sqlite").schema("id string, n long").options(path=path, table="tasks", filters="push").load().where("id in ('t5', 't7')")
        assert sorted(r.n for r in one.collect()) == [5, 7]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")

"""Logs of commands and keyed submissions against a table of all tasks and keys that is changed one by one."""

import random

import pytest

from taskledger.operators.fold import ARGUMENTS, COMMANDS, STATE, SUBMISSION, decide, fold_log, new_state, step
from taskledger.schema import CONFLICTS, KEY_SCHEMA, TASK_COLUMNS, TASK_SCHEMA

LEASE, DELAY = 100, 30
LOG = "id string, seq long, " + ", ".join(f"{k} {t}" for k, t in {**ARGUMENTS, **SUBMISSION}.items())
FIELDS = ["id", "seq", *ARGUMENTS, *SUBMISSION]
BLANK = dict(name="x", queue="q", status="queued", payload="{}", metadata="{}", attempt=0, max_attempts=2, priority=0, run_at_ms=0, created_at_ms=0, updated_at_ms=0)


def a_log(seed, n=400):
    draw, out, ids, now = random.Random(seed), [], [f"t{i}" for i in range(6)], 0
    for seq in range(n):
        now += draw.choice([0, 5, 20, 60])
        if draw.random() < 0.25:
            row = dict(id=f"n{seq}", op="submit", key=draw.choice([*"abcde", "free", None]), conflict=draw.choice(CONFLICTS), name=f"name{seq}", max_attempts=draw.choice([None, 1, 2]), start_delay_ms=draw.choice([None, 0, 40]), queue=draw.choice([None, "gpu"]))
            ids.append(row["id"])
            if draw.random() < 0.1:
                row |= draw.choice([dict(max_attempts=0), dict(conflict="no such", key="a"), dict(start_delay_ms=-1)])
        else:
            row = dict(id=draw.choice(ids[-4:] + ids[:3] + ["unknown", None]), op=draw.choice([*COMMANDS, "claim", "claim"]), worker=f"w{draw.random() < 0.2:d}", result=draw.choice([None, "{}"]), error=draw.choice([None, "{}"]), retryable=draw.choice([None, True, False]))
        out.append(row | dict(seq=seq, now_ms=None if draw.random() < 0.03 else now))
    return out


def one_by_one(tasks, keys, log):
    states = {i: {k: t.get(k) for k in STATE} | {"applied": 0, "lost": 0} for i, t in tasks.items()}
    keys, decisions, lost = dict(keys), {}, {}
    for row in log:
        c = {k: row.get(k) for k in ARGUMENTS}
        if row["op"] != "submit":
            if row["id"] in states:
                step(states[row["id"]], c, LEASE, DELAY)
            elif row["id"] is not None:
                lost[row["id"]] = lost.get(row["id"], 0) + 1
            continue
        key, conflict, id_ = row.get("key"), row["conflict"], row["id"]
        if c["now_ms"] is None or key is not None and conflict not in CONFLICTS or row.get("max_attempts") is not None and row["max_attempts"] < 1 or (row.get("start_delay_ms") or 0) < 0:
            decisions[row["seq"]] = ("invalid", None, None)
            continue
        now_id = keys.get(key) if key is not None else None
        status = states[now_id]["status"] if now_id in states else None
        active = status in ("queued", "running")
        if status and {"reuse": active, "reuse-succeeded": active or status == "succeeded", "reject": True, "replace": False}[conflict]:
            decisions[row["seq"]] = ("reject", None, None) if conflict == "reject" else ("return", now_id, None)
            continue
        stops = now_id if active and conflict == "replace" else None
        if stops:
            step(states[stops], dict.fromkeys(ARGUMENTS) | {"op": "cancel", "now_ms": c["now_ms"]}, LEASE, DELAY)
        decisions[row["seq"]] = ("insert", id_, stops)
        states[id_] = new_state(c["now_ms"], row.get("max_attempts") or 3, row.get("start_delay_ms") or 0)
        if key is not None:
            keys[key] = id_
    return states, keys, decisions, lost


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_log_equals_one_by_one(spark, seed):
    tasks = {f"t{i}": BLANK | {"id": f"t{i}"} for i in range(6)}
    keys = {"a": "t0", "b": "t1", "c": "t2", "gone": "t9", "d": "t8"}
    log = a_log(seed)
    rows = spark.createDataFrame([tuple(t.get(c) for c in TASK_COLUMNS) for t in tasks.values()], TASK_SCHEMA)
    pointers = spark.createDataFrame([(k, t, 0, 0) for k, t in keys.items()], KEY_SCHEMA)
    frame = spark.createDataFrame([tuple(r.get(c) for c in FIELDS) for r in random.Random(seed).sample(log, len(log))], LOG).repartition(3)
    states, after, decisions, unknown = one_by_one(tasks, keys, log)
    folded = fold_log(rows, pointers, frame, LEASE, DELAY)
    assert {r.seq: (r.decision, r.task_id, r.cancels) for r in folded.decisions.collect()} == decisions
    assert len({d[0] for d in decisions.values()}) == 4 and sum(d[2] is not None for d in decisions.values()) > 2
    assert {r.key: r.task_id for r in folded.pointers.collect()} == {k: t for k, t in after.items() if t != keys.get(k)}
    got = {r.id: r for r in folded.changes.collect()}
    carried = [k for k in STATE if k in TASK_COLUMNS]
    assert {i: {k: r[k] for k in carried} for i, r in got.items()} == {i: {k: s[k] for k in carried} for i, s in states.items() if s["applied"] or i not in tasks}
    submitted = {r["id"]: r for r in log if r["op"] == "submit"}
    assert all(r.name == submitted[i]["name"] and r.queue == (submitted[i]["queue"] or "default") and r.created_at_ms == submitted[i]["now_ms"] and r.root_id == i for i, r in got.items() if i not in tasks)
    lost = {r.id: r.lost for r in folded.lost.collect()}
    before = {}
    for i in (i for i in states if i not in tasks):  # commands before a task was put in
        born = submitted[i]["seq"]
        before[i] = sum(r["id"] == i and r["op"] != "submit" and r["seq"] < born for r in log)
    assert lost == {i: n for i, n in ({i: s["lost"] + before.get(i, 0) for i, s in states.items()} | unknown).items() if n}


def test_empty_log_and_poison(spark):
    rows = spark.createDataFrame([tuple((BLANK | {"id": "t"}).get(c) for c in TASK_COLUMNS)], TASK_SCHEMA)
    keys = spark.createDataFrame([], KEY_SCHEMA)
    assert all(df.count() == 0 for df in fold_log(rows, keys, spark.createDataFrame([], LOG)))
    poison = [dict(id="t", seq=None, op="claim", now_ms=5, worker="w"), dict(id="t", seq=1, op=None, now_ms=None), dict(id=None, seq=2, op="submit", key="k", conflict="reuse", now_ms=1), dict(id="t", seq=3, op="no such", now_ms=9)]
    folded = fold_log(rows, keys, spark.createDataFrame([tuple(r.get(c) for c in FIELDS) for r in poison], LOG))
    assert [(r.id, r.status) for r in folded.changes.collect()] == [("t", "running")]
    assert [(r.id, r.lost) for r in folded.lost.collect()] == [("t", 1)]
    assert [r.decision for r in folded.decisions.collect()] == ["invalid"]


def test_stream_with_submissions_and_restart(spark, tmp_path):
    from taskledger.plans import read_table, read_version, write_version
    from taskledger.streaming.commands import LOG_SCHEMA, apply_stream

    tasks = {f"t{i}": BLANK | {"id": f"t{i}"} for i in range(6)}
    keys = {"a": "t0", "b": "t1", "c": "t2"}
    log = a_log(7, 240)
    states, after, decisions, unknown = one_by_one(tasks, keys, log)
    root, source, checkpoint = (str(tmp_path / n) for n in ("ledger", "log", "checkpoint"))
    rows = spark.createDataFrame([tuple(t.get(c) for c in TASK_COLUMNS) for t in tasks.values()], TASK_SCHEMA)
    write_version(rows, root, 0, {"keys": spark.createDataFrame([(k, t, 0, 0) for k, t in keys.items()], KEY_SCHEMA)})
    for n, low in enumerate((0, 80, 160)):
        part = [tuple(r.get(c) for c in FIELDS) for r in log[low : low + 80]]
        spark.createDataFrame(part, LOG_SCHEMA).coalesce(1).write.mode("append").json(source)
        query = apply_stream(spark.readStream.schema(LOG_SCHEMA).json(source), root, checkpoint, LEASE, DELAY, compact=2)
        assert query.awaitTermination(240) and query.exception() is None
    got = {r.id: r for r in read_version(spark, root, 3, TASK_SCHEMA).collect()}
    carried = [k for k in STATE if k in TASK_COLUMNS]
    assert {i: {k: r[k] for k in carried} for i, r in got.items()} == {i: {k: s[k] for k in carried} for i, s in states.items()}
    assert {r.key: r.task_id for r in read_table(spark, root, 3, "keys", KEY_SCHEMA, by="key").collect()} == after
    found = spark.read.parquet(*[f"{root}/decisions={n}" for n in (1, 2, 3)])
    assert {r.seq: (r.decision, r.task_id, r.cancels) for r in found.collect()} == decisions


def test_tables_of_a_version_are_there_together_or_not(spark, tmp_path):
    from pyspark.sql import functions as F

    from taskledger.operators.settle import complete_in
    from taskledger.plans import latest_version, read_table, read_version, write_version

    root = str(tmp_path / "ledger")
    tasks = spark.createDataFrame([tuple((BLANK | dict(id=f"t{i}", status="running", worker_id="w", lease_until_ms=100)).get(c) for c in TASK_COLUMNS) for i in range(20)], TASK_SCHEMA)
    write_version(tasks, root, 0)
    outcomes = spark.createDataFrame([(f"t{i}", "w" if i % 2 else "other", "{}") for i in range(10)], "id string, worker string, result string")
    own = spark.createDataFrame([(f"t{i % 12}", i) for i in range(40)], "id string, n int").repartition(4)

    def state():
        version = latest_version(spark, root)
        done = {r.id for r in read_version(spark, root, version, TASK_SCHEMA).where("status = 'succeeded'").collect()}
        return version, done, sorted(r.n for r in read_table(spark, root, version, "own", own.schema).collect())

    bad = own.withColumn("n", F.when(F.col("n") == 33, F.raise_error(F.lit("stopped")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="stopped"):
        complete_in(tasks, outcomes, {"own": bad}, root, 1, 50)
    assert state() == (0, set(), [])
    lost = complete_in(tasks, outcomes, {"own": own}, root, 1, 50)
    assert {r.id for r in lost.collect()} == {f"t{i}" for i in range(0, 10, 2)}
    assert state() == (1, {f"t{i}" for i in range(1, 10, 2)}, [n for n in range(40) if n % 12 in range(1, 10, 2)])
    with pytest.raises(ValueError, match="named"):
        complete_in(tasks, outcomes, {"live": own}, root, 2, 50)


def test_few_ids_read_few_buckets(spark, tmp_path):
    from taskledger.plans import read_table, read_version, write_changes, write_version
    from taskledger.plans.versions import bucket_of

    root = str(tmp_path / "ledger")
    tasks = spark.createDataFrame([tuple((BLANK | dict(id=f"t{i}", status="queued" if i % 3 else "failed")).get(c) for c in TASK_COLUMNS) for i in range(600)], TASK_SCHEMA)
    keys = spark.createDataFrame([(f"k{i}", f"t{i}", 0, 0) for i in range(600)], KEY_SCHEMA)
    write_version(tasks, root, 0, {"keys": keys})
    write_changes(tasks.where("id in ('t5', 't9', 't77')").withColumn("message", tasks["id"]), root, 1, {"keys": keys.where("key = 'k5'").withColumn("task_id", keys["key"])})
    only = spark.createDataFrame([("t5",), ("t6",), ("gone",)], "id string")
    found = read_version(spark, root, 1, TASK_SCHEMA, only=only)
    assert sorted((r.id, r.message) for r in found.collect()) == [("t5", "t5"), ("t6", None)]
    buckets = {r[0] for r in only.select(bucket_of("id")).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and all(str(b) in plan.split("PartitionFilters")[1][:400] for b in buckets)
    assert sorted((r.key, r.task_id) for r in read_table(spark, root, 1, "keys", KEY_SCHEMA, by="key", only=spark.createDataFrame([("k5",), ("k7",)], "key string")).collect()) == [("k5", "k5"), ("k7", "t7")]
    assert read_version(spark, root, 1, TASK_SCHEMA).count() == 600 and read_version(spark, root, 1, TASK_SCHEMA, "terminal").count() == 200

"""Streams of changes and of timers, with restarts."""

import time

import pytest

from taskledger.functions.expressions import is_due
from taskledger.operators import reads, transitions as move
from taskledger.plans import read_version, write_changes, write_version
from taskledger.schema import TASK_COLUMNS, TASK_SCHEMA
from taskledger.sources.changes import ChangeSource
from taskledger.streaming.timers import STATE_STORE, timers

BLANK = dict(name="x", queue="q", status="queued", payload="{}", metadata="{}", attempt=0, max_attempts=3, priority=0, run_at_ms=0, created_at_ms=0, updated_at_ms=0)


@pytest.fixture
def tasks(spark):
    def build(*rows):
        return spark.createDataFrame([tuple((BLANK | r).get(c) for c in TASK_COLUMNS) for r in rows], TASK_SCHEMA)

    spark.dataSource.register(ChangeSource)
    return build


def run(stream, out, checkpoint):
    query = stream.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None


def test_changes_are_told_once_across_restarts(spark, tasks, tmp_path):
    root, out, checkpoint = (str(tmp_path / n) for n in ("ledger", "out", "checkpoint"))
    write_version(tasks(*[dict(id=f"t{i}", queue="ab"[i % 2]) for i in range(8)]), root, 0)

    def stream(**more):
        return spark.readStream.format("ledger_changes").options(path=root, **more).load()

    def told():
        return sorted((r.version, r.reason, r.queue, r.id) for r in spark.read.schema("version int, reason string, queue string, id string").json(out).collect())

    want = []

    def change(version, change):
        before = read_version(spark, root, version - 1, TASK_SCHEMA)
        write_changes(change(before), root, version)
        want.extend((version, r.reason, r.queue, r.id) for r in reads.change_feed(before, read_version(spark, root, version, TASK_SCHEMA)).collect())

    change(1, lambda t: move.claim(t, "w", 5, 100, 4))
    change(2, lambda t: move.recover_leases(t.where("id < 't3'"), 500).unionByName(move.cancel(t.where("status = 'queued'"), 500)))
    run(stream(), out, checkpoint)
    assert told() == sorted(want) and {w[1] for w in want} == {"queued", "done"}
    run(stream(), out, checkpoint)  # nothing new
    change(3, lambda t: move.retry(t, 600).unionByName(tasks(dict(id="new", queue="b"))))
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{root}/changes=4/class=live/half")  # a writer that died
    (tmp_path / "ledger" / "changes=4" / "class=live" / "half" / "_SUCCESS").unlink()
    run(stream(), out, checkpoint)
    assert told() == sorted(want)
    only = str(tmp_path / "only")
    run(stream(queues="a", after="1"), only, str(tmp_path / "checkpoint2"))
    out = only
    assert told() == sorted(w for w in want if w[0] > 1 and (w[1] == "done" or w[2] == "a"))


def test_timers_fall_due_without_commands(spark, tasks, tmp_path):
    root, out, checkpoint = (str(tmp_path / n) for n in ("ledger", "out", "checkpoint"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, STATE_STORE)
    now = int(time.time() * 1000)
    rows = [dict(id=f"lease{i}", status="running", worker_id="w", attempt=1, lease_until_ms=now + 1000 * i) for i in (-5, 4, 8, 900)]
    rows += [dict(id=f"wait{i}", run_at_ms=now + 1000 * i) for i in (-5, 6, 900)] + [dict(id="done", status="failed", completed_at_ms=1)]
    write_version(tasks(), root, 0)
    write_changes(tasks(*rows), root, 1)

    def start():
        changes = spark.readStream.format("ledger_changes").options(path=root, running="true").load()
        return timers(changes).writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start()

    def fallen():
        return {(r.id, r.op, r.now_ms) for r in spark.read.schema("id string, op string, now_ms long").json(out).collect()}

    def until(n):
        end = time.time() + 90
        while len(fallen()) < n and time.time() < end and query.isActive:
            time.sleep(0.5)
        assert query.exception() is None

    try:
        query = start()
        until(2)
        query.stop()  # timers outlive the stream
        renewed = {"id": "lease900", "status": "running", "worker_id": "w", "attempt": 1, "lease_until_ms": now + 12_000}
        write_changes(tasks(renewed), root, 2)
        query = start()
        until(6)
        query.stop()
    finally:
        spark.conf.set(provider, before)
    all_rows = [r for r in rows if r["id"] != "lease900"] + [renewed]
    over = {(r.id, "expire") for r in move.recover_leases(tasks(*all_rows), now + 60_000).collect()} | {(r.id, "due") for r in tasks(*all_rows).where(is_due(now + 60_000)).collect()}
    got = fallen()
    assert {g[:2] for g in got} == over and len(got) == len(over) == 6
    at = {r["id"]: r.get("lease_until_ms") or r.get("run_at_ms") for r in all_rows}
    assert {g[0]: g[2] for g in got} == {g[0]: at[g[0]] for g in got}

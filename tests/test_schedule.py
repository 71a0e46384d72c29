"""Joint ceilings against a plain loop, limits of retention rules, ids and quarantine."""

import random

import pytest
from pyspark.sql import functions as F

from taskledger.functions.documents import ALPHABET
from taskledger.operators import transitions as move
from taskledger.operators.ingest import id_of, ingest, with_ids
from taskledger.operators.schedule import Draw, claim_by_ceilings, draws_of
from taskledger.schema import TASK_COLUMNS, TASK_SCHEMA

NOW = 1000


def table(spark, rows):
    blank = dict(queue="q", payload="{}", metadata="{}", attempt=0, max_attempts=3, priority=0, run_at_ms=0, created_at_ms=0, updated_at_ms=0)
    return spark.createDataFrame([tuple((blank | {"id": f"t{i:04}"} | r).get(c) for c in TASK_COLUMNS) for i, r in enumerate(rows)], TASK_SCHEMA)


def plain(rows, draws, free, resources, start, claim_batch):
    due = [f"t{i:04}" for i, r in enumerate(rows) if r["status"] == "queued"]
    name = {f"t{i:04}": r["name"] for i, r in enumerate(rows)}
    flying = [-(-sum(r["status"] == "running" and r.get("worker_id") == "w" and r["name"] in d.names for r in rows) // d.batch) for d in draws]
    left, taken, out = free, dict.fromkeys(resources, 0), set()
    for i in [(start + k) % len(draws) for k in range(len(draws))]:
        d = draws[i]
        most = [left]
        if claim_batch:
            most.append(max(1, claim_batch // d.batch))
        if d.concurrency is not None:
            most.append(max(0, d.concurrency - flying[i]))
        if d.resource:
            most.append(max(0, resources[d.resource] - sum(f for f, e in zip(flying, draws) if e.resource == d.resource) - taken[d.resource]))
        mine = sorted((-rows[int(t[1:])].get("priority", 0), t) for t in due if name[t] in d.names)[: d.batch * max(0, min(most))]
        out |= {(t, name[t], i, k // d.batch) for k, (_, t) in enumerate(mine)}
        calls = -(-len(mine) // d.batch)
        left -= calls
        if d.resource:
            taken[d.resource] += calls
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ceilings_equal_a_loop(spark, seed):
    draw = random.Random(seed)
    handlers = {"a": dict(batch=3, resource="r"), "b": dict(concurrency=draw.randrange(4)), "c": dict(batch=2, concurrency=3, resource="r"), "d": {}, "e": {}, "f": dict(resource="s")}
    draws = draws_of(handlers)
    assert draws[-1] == Draw(("d", "e")) and len(draws) == 5
    rows = [dict(name=draw.choice("abcdefg"), status=draw.choice(["queued", "queued", "running", "failed"]), worker_id=draw.choice("wv"), lease_until_ms=NOW + 1, priority=draw.randrange(3)) for _ in range(150)]
    for free, start, batch in ((5, 0, None), (12, seed, 4), (0, 1, None), (60, 3, 1)):
        got = {tuple(r) for r in claim_by_ceilings(table(spark, rows), draws, "w", NOW, free, {"r": 9, "s": 4}, start, batch).collect()}
        assert got == plain(rows, draws, free, {"r": 9, "s": 4}, start, batch)
    assert claim_by_ceilings(table(spark, rows), [], "w", NOW, 5, {}).count() == 0


def test_limits_of_overlapping_rules(spark):
    rows = [dict(name="x", status="failed" if i % 2 else "succeeded", completed_at_ms=i) for i in range(40)]
    rules = "older_than_ms long, queue string, status string, name string, limit int"
    gone = lambda *r: sorted(x.id for x in move.purge_by_rules(table(spark, rows), spark.createDataFrame(r, rules), NOW).collect())
    assert gone((0, None, None, None, 3), (0, None, "failed", None, 2)) == ["t0000", "t0001", "t0002", "t0003"]
    assert gone((0, None, None, None, 3), (NOW - 5, None, None, None, None)) == [f"t{i:04}" for i in range(5)]
    assert gone((NOW, None, None, None, 3)) == []
    with pytest.raises(ValueError):
        gone((0, None, None, None, 0))


def test_ids_order_by_time_and_are_unique(spark):
    made = with_ids(spark.range(1_000_000).withColumn("ms", F.col("id") * 1_700_000 + 5), F.col("ms"), "task")
    assert made.select("task").distinct().count() == 1_000_000
    assert made.select("id", "task").orderBy("task").rdd.map(lambda r: r.id).zipWithIndex().filter(lambda x: x[0] != x[1]).isEmpty()
    assert {r.task for r in made.where("id < 5").collect()} == {r.task for r in made.where("id < 5").collect()}
    one = spark.range(1).select(id_of(F.lit(1_700_000_000_123), F.lit((1 << 40) - 1), F.lit(33))).first()[0]
    value = 0
    for c in one.removeprefix("task_"):
        value = value << 5 | ALPHABET.index(c)
    assert len(one) == 31 and value == (1_700_000_000_123 << 80) | (((1 << 40) - 1) << 40) | 33


def test_ingest(spark):
    good = ('{"a": 1.0,\t"é":[]}', "{}", 1, 0, "reuse")
    cases = {"name": ("", *good), "payload": ("n", "{", *good[1:]), "metadata": ("n", good[0], "x", *good[2:]), "metadata_object": ("n", good[0], "[1]", *good[2:]), "max_attempts": ("n", *good[:2], 0, 0, "reuse"), "delay_ms": ("n", *good[:3], -1, "reuse"), "conflict": ("n", *good[:4], "no such")}
    rows = spark.createDataFrame([("n", *good), ("n", "null", None, None, None, None), *cases.values(), (None, *good), ("n", None, *good[1:])], "name string, payload string, metadata string, max_attempts int, delay_ms long, conflict string")
    split = ingest(rows)
    assert [r.payload for r in split.valid.collect()] == [good[0], "null"]
    assert [r.reason for r in split.quarantined.collect()] == [*cases, "name", "payload"]
    assert ingest(rows.select("name", "payload")).quarantined.count() == 4
    assert move.insert_tasks(split.valid.withColumn("id", F.lit("t")), 5).count() == 2

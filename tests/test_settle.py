"""How calls end and what becomes of their tasks, case by case; ranges; admission."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from taskledger.operators import reads
from taskledger.operators.settle import COMPLETE, FAIL, OUTCOME, SUCCEED, UNSERIALIZABLE, Delivery, LostLease, TaskError, _pieces, deliver, reason, settle
from taskledger.plans.ranges import numbered
from taskledger.schema import TASK_COLUMNS, TASK_SCHEMA, UNWRITABLE_ERROR

NOW = 1_000_000


def table(spark, *rows):
    blank = dict(name="x", queue="default", status="running", worker_id="w", lease_until_ms=NOW + 1, payload="{}", metadata="{}", attempt=1, max_attempts=3, priority=0, run_at_ms=0, created_at_ms=0, updated_at_ms=0)
    full = [blank | {"id": f"t{i:03}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in TASK_COLUMNS) for r in full], TASK_SCHEMA)


def call(handler, batched=False, n=1, max_run_ms=None):
    one = Delivery("x", pd.DataFrame({"id": [f"t{i}" for i in range(n)]}))
    one.run(handler, batched, max_run_ms)
    return {k: (v[0], v[1], json.loads(v[3])["code"] if v[3] else None, v[4]) for k, v in one.outcomes.items()}


def raising(error):
    def handler(_):
        raise error

    return handler


def test_every_way_a_call_ends():
    assert call(lambda _: {"a": [1, None]}) == {"t0": (COMPLETE, '{"a":[1,null]}', None, None)}
    assert call(lambda _: None) == {"t0": (COMPLETE, None, None, None)}
    assert call(lambda _: {"t1": 5, "other": 6}, True, 2) == {"t0": (COMPLETE, None, None, None), "t1": (COMPLETE, "5", None, None)}
    assert call(lambda _: "no mapping", True) == {"t0": (COMPLETE, None, None, None)}
    assert call(raising(TaskError("no", code="c"))) == {"t0": (FAIL, None, "c", False)}
    assert call(raising(TaskError("no", retryable=True, details={1, 2}))) and call(raising(TaskError("no", retryable=True)))["t0"][3] is True
    assert call(raising(KeyError("k")), True, 2) == {f"t{i}": (FAIL, None, "handler_error", True) for i in range(2)}
    assert call(raising(LostLease())) == {}
    for bad in (float("nan"), {1, 2}, object(), b"x"):
        assert call(lambda _: bad) == {"t0": (FAIL, None, "unserializable_result", False)}


def test_tasks_settled_by_the_handler_stay():
    def handler(one):
        assert one.succeed("t0", 1) and not one.fail("t0", "late") and not one.succeed("t0", 2)
        assert one.fail("t1", "no source", retryable=False)
        if one.name == "x":
            raise LostLease

    assert call(handler, True, 3) == {"t0": (SUCCEED, "1", None, None), "t1": (FAIL, None, "task_error", False)}


def test_a_call_that_runs_too_long():
    def slow(one):
        one.succeed("t0")
        try:
            time.sleep(20)
        except Exception:
            pass

    began = time.time()
    assert call(slow, True, 2, max_run_ms=50) == {"t0": (SUCCEED, None, None, None), "t1": (FAIL, None, "handler_timeout", True)}
    assert time.time() - began < 5
    assert call(lambda _: 1, max_run_ms=5000)["t0"][1] == "1"


def test_reasons():
    assert json.loads(reason(ValueError("x"))[0]) == {"type": "ValueError", "code": "handler_error", "message": "x", "retryable": True, "details": {}}
    assert reason({"own": 1}, False) == ('{"own":1}', False)
    assert json.loads(reason({"own": float("inf")})[0]) == {"own": "inf"}
    assert json.loads(reason("words", False)[0])["type"] == "TaskError"
    assert json.loads(reason(TaskError("m", details={"d": object}))[0])["details"].keys() == {"d"}


def test_deliver_and_settle(spark):
    rows = [dict(name="batch")] * 7 + [dict(name="one")] * 3 + [dict(name="bad")] * 2

    def handler(one):
        assert len(one.tasks) <= (3 if one.name == "batch" else 1)
        if one.name == "bad":
            raise OSError("down")
        return {one.tasks["id"].iloc[0]: len(one.tasks)} if one.name == "batch" else one.tasks["id"].iloc[0]

    tasks = table(spark, *rows)
    got = {r.id: r for r in deliver(tasks, {"batch": 3}, handler).collect()}
    assert {i: got[f"t{i:03}"].result for i in range(7)} == {0: "3", 1: None, 2: None, 3: "3", 4: None, 5: None, 6: "1"}
    assert all(got[f"t{i:03}"].result == f'"t{i:03}"' for i in (7, 8, 9)) and {got[f"t{i:03}"].kind for i in (10, 11)} == {FAIL}
    after = {r.id: r for r in settle(tasks, deliver(tasks, {"batch": 3}, handler), NOW, 1000, 30_000, F.lit(0.999)).collect()}
    assert [after[f"t{i:03}"].status for i in range(12)] == ["succeeded"] * 10 + ["queued"] * 2
    assert after["t010"].run_at_ms == NOW + 500 + 499


def test_calls_that_wait_or_run_too_long_dont_hold_up_others(spark):
    def handler(one):
        time.sleep(0.5 if one.ids[0] < "t024" else 60)

    tasks = table(spark, *[dict(name="slow")] * 48)
    began = time.time()
    got = {r.id: r for r in deliver(tasks, {}, handler, max_run_ms=1000).collect()}
    assert time.time() - began < 24  # one after another they take 36 seconds
    assert [got[f"t{i:03}"].kind for i in range(48)] == [COMPLETE] * 24 + [FAIL] * 24
    assert {json.loads(r.error)["code"] for r in got.values() if r.error} == {"handler_timeout"}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_pieces_are_whole_deliveries(size):
    rows = pd.DataFrame({"id": range(60), "name": ["a"] * 30 + ["b"] * 30, "chunk": [i // 7 for i in range(30)] + list(range(29)) + [28]})
    got = [p.iloc[a:b]["id"].tolist() for p, ends in _pieces((rows.iloc[i : i + size] for i in range(0, 60, size)), 2) for a, b in zip(ends, ends[1:])]
    assert got == [list(range(0, 7)), list(range(7, 14)), list(range(14, 21)), list(range(21, 28)), [28, 29], *[[i] for i in range(30, 58)], [58, 59]]
    assert not list(_pieces(iter([]), 2)) and not list(_pieces(iter([rows.iloc[:0]]), 2))


def test_in_the_tasks_own_process(spark):
    rows = [(r.id, r.result) for r in deliver(table(spark, {}, {}), {}, lambda one: one.tasks.index.tolist(), calls=1).collect()]
    assert sorted(rows) == [("t000", "[0]"), ("t001", "[0]")]


@pytest.mark.parametrize("more,outcome,want", [
    ({}, (COMPLETE, "{}", None, None), dict(status="succeeded", result="{}", error=None)),
    ({}, (COMPLETE, "{bad", None, None), dict(status="failed", error=UNSERIALIZABLE)),
    ({}, (SUCCEED, "NaN", None, None), dict(status="failed", error=UNSERIALIZABLE)),
    (dict(cancel_requested_at_ms=1), (COMPLETE, "1", None, None), dict(status="canceled", result=None)),
    (dict(cancel_requested_at_ms=1), (SUCCEED, "1", None, None), dict(status="succeeded", result="1")),
    (dict(cancel_requested_at_ms=1), (FAIL, None, "{}", True), dict(status="canceled", error="{}")),
    ({}, (FAIL, None, '{"a":1}', None), dict(status="queued", error='{"a":1}', worker_id=None, run_at_ms=NOW + 500)),
    (dict(attempt=3), (FAIL, None, "{}", True), dict(status="failed", run_at_ms=0)),
    ({}, (FAIL, None, "[1]", False), dict(status="failed", error=UNWRITABLE_ERROR)),
    (dict(worker_id="other"), (COMPLETE, "1", None, None), None),
    (dict(lease_until_ms=NOW), (COMPLETE, "1", None, None), None),
    ({}, ("unknown", "1", None, None), None),
])
def test_settle(spark, more, outcome, want):
    kind, result, error, retryable = outcome
    rows = spark.createDataFrame([("t000", "w", kind, result, None, error, retryable)], OUTCOME)
    found = settle(table(spark, more), rows, NOW, random=F.lit(0.0)).collect()
    assert [{k: r[k] for k in want} for r in found] == [want] if want else found == []


@pytest.mark.parametrize("hot", [False, True])
def test_numbers_equal_a_window(spark, hot):
    rows = spark.range(3000).select((F.col("id") % 700 if not hot else F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1)).alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("a"), "id").repartition(5)
    order = Window.partitionBy("g").orderBy("a", "id")
    rows = rows.withColumn("x", F.when(F.col("id") % 3 > 0, F.col("id")))
    want = rows.withColumns({"place": F.row_number().over(order) - 1, "before_a": F.coalesce(F.sum("a").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "first_x": F.first("x").over(order), "last_x": F.lag("x").over(order)})
    got = numbered(rows, ["g"], [F.col("a"), F.col("id")], ["a"], ["x"])
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_admission(spark):
    arrivals = spark.createDataFrame([(i, q) for i, q in enumerate(["a", "a", None, "a", "b", None, "full"])], "seq long, queue string")
    tasks = table(spark, dict(queue="a", status="queued"), dict(queue="a", status="running"), dict(queue="full", status="queued"), dict(queue="full", status="queued"))

    def admitted(limits):
        return sorted((r.queue, r.seq, r.admitted) for r in reads.admitted(arrivals, tasks, limits).collect())

    assert [x for *_, x in admitted(2)] == [True, False, False, True, True, True, False]
    assert [x for *_, x in admitted({"full": 2, "a": 9})] == [True] * 6 + [False]
    assert reads.admitted(arrivals.limit(0), tasks, 1).count() == 0
    for bad in (0, {"a": 0}):
        with pytest.raises(ValueError):
            reads.admitted(arrivals, tasks, bad)


def test_byte_budget_beside_what_is_in_flight(spark):
    claimed = table(spark, *[dict(name=n, payload="x" * b) for n, b in (("a", 10), ("a", 10), ("a", 10), ("b", 99), ("c", 10))])
    flying = table(spark, dict(name="a", payload="x" * 5), dict(name="c", payload="x" * 30))
    assert sorted(r.id for r in reads.within_bytes(claimed, 25).collect()) == ["t000", "t001", "t003", "t004"]
    assert sorted(r.id for r in reads.within_bytes(claimed, 25, flying).collect()) == ["t000", "t001", "t003"]

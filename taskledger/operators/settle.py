"""How handlers' calls end, as data, and what becomes of their tasks.

A call that raises doesn't end the job: what it raised is its tasks' outcome. Outcomes are rows, and one join
settles them all: each task is completed, succeeded, failed with backoff, failed for good, or left alone.
"""

from __future__ import annotations

import gc
import multiprocessing
import os
import signal
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ProcessPoolExecutor, wait
from contextlib import contextmanager
from functools import cached_property, partial
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import dump, envelope, is_json
from ..functions.expressions import backoff_delay
from ..plans.ranges import kept
from ..plans.versions import write_changes
from .reads import with_chunks
from .transitions import _of, _tasks_only, complete, completed_values, failed_values, succeeded_values

#: Kinds of outcomes: finished unless a cancel was asked, finished in any case, failed.
COMPLETE, SUCCEED, FAIL = "complete", "succeed", "fail"
OUTCOME = "id string, worker string, kind string, result string, message string, error string, retryable boolean"
#: The error of a result that isn't JSON.
UNSERIALIZABLE = envelope("SerializationError", "unserializable_result", "the handler's result is no JSON", False)
BACKOFF_MS, BACKOFF_MAX_MS = 1_000, 30_000
#: Calls that a task of the cluster makes at once; rows of whole deliveries that a process gets at a time at last, and outcomes that Spark does, at least.
CALLS, PIECE, BATCH = 16, 128, 10_000


class TaskError(Exception):
    """What a handler raises to say how its tasks fail: for good, unless it is retryable."""

    def __init__(self, message: str, code: str = "task_error", retryable: bool = False, type: str = "TaskError", details: dict | None = None) -> None:
        super().__init__(message)
        self.code, self.retryable, self.type, self.details = code, retryable, type, details


class LostLease(Exception):
    """What a handler raises that has lost its tasks: nothing is recorded."""


class _TimeUp(BaseException):
    """Ends a call that ran too long; no handler's `except Exception` holds it."""


def reason(error: object, retryable: bool = True) -> tuple[str, bool]:
    """(envelope, retryable) of what a call raised or a task is failed with: an exception, an envelope, or words."""
    if not isinstance(error, (BaseException, dict)):
        error = TaskError(str(error), retryable=retryable)
    if isinstance(error, TaskError):
        retryable, found = error.retryable, (error.type, error.code, str(error), error.retryable, error.details)
    elif isinstance(error, dict):
        try:
            return dump(error), retryable
        except (TypeError, ValueError):
            return dump({str(k): str(v) for k, v in error.items()}), retryable
    else:
        found = (type(error).__name__, "handler_error", str(error), retryable, {})
    try:
        return envelope(*found), retryable
    except (TypeError, ValueError):
        details = found[4] if isinstance(found[4], dict) else {"value": found[4]}
        return envelope(*found[:4], {str(k): str(v) for k, v in details.items()}), retryable


class Delivery:
    """A call's tasks (a pandas frame) and their ids, and the means to settle some before the call ends. A task that is settled stays as it was settled first."""

    def __init__(self, name: str, tasks: pd.DataFrame | Callable[[], pd.DataFrame], ids: list[str] | None = None) -> None:
        self.name, self._tasks, self.outcomes = name, tasks, {}
        self.ids = self.tasks["id"].tolist() if ids is None else ids

    @cached_property
    def tasks(self) -> pd.DataFrame:
        """Made when it is asked for: to cut a frame for each call takes longer than many a call."""
        return self._tasks() if callable(self._tasks) else self._tasks

    def succeed(self, id: str, result: object = None, message: str | None = None) -> bool:
        return self._put(id, SUCCEED, result, message)

    def fail(self, id: str, error: object, retryable: bool = True) -> bool:
        text, again = reason(error, retryable)
        return self._settle(id, (FAIL, None, None, text, again))

    def _put(self, id: str, kind: str, result: object, message: str | None = None) -> bool:
        try:
            return self._settle(id, (kind, None if result is None else dump(result), message, None, None))
        except (TypeError, ValueError, RecursionError):
            return self._settle(id, (FAIL, None, None, UNSERIALIZABLE, False))

    def _settle(self, id: str, outcome: tuple) -> bool:
        new = id not in self.outcomes
        self.outcomes.setdefault(id, outcome)
        return new

    def run(self, handler: Callable[[Delivery], object], batched: bool, max_run_ms: int | None) -> None:
        """Calls the handler and settles by how that ends what it left unsettled."""
        ids = self.ids
        try:
            with _within(max_run_ms):
                result = handler(self)
        except LostLease:
            return
        except _TimeUp:
            error = {"type": "HandlerTimeout", "code": "handler_timeout", "message": f"a call of {self.name} ran longer than {max_run_ms} ms", "retryable": True, "details": {}}
            for id in ids:
                self.fail(id, error, True)
            return
        except Exception as e:
            for id in ids:
                self.fail(id, e)
            return
        results = (result if isinstance(result, dict) else {}) if batched else dict.fromkeys(ids, result)
        for id in ids:
            if id not in self.outcomes:
                self._put(id, COMPLETE, results.get(id))


@contextmanager
def _within(ms: int | None) -> Iterator[None]:
    """Ends what runs in it after some time. Spark calls handlers in their processes' main threads, where a timer's signal comes between two steps of Python."""
    if not ms or threading.current_thread() is not threading.main_thread():
        yield
        return

    def end(*_) -> None:
        raise _TimeUp

    before = signal.signal(signal.SIGALRM, end)
    signal.setitimer(signal.ITIMER_REAL, ms / 1000)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def deliver(claimed: DataFrame, batch_sizes: dict[str, int], handler: Callable[[Delivery], object], max_run_ms: int | None = None, calls: int = CALLS) -> DataFrame:
    """The outcomes (OUTCOME) of a call for each delivery of claimed tasks.

    A name with a batch size gets up to so many tasks a call, and what it returns maps ids to results; others get one, and return its
    result. Tasks whose call lost its lease have no outcome. A task of the cluster that is run again calls its handlers again: calls are made at least once.

    calls: how many run at once in each task of the cluster, in processes of their own, so that a call that waits, or is ended only after max_run_ms, doesn't hold up the others. With 1 they run in the task's own process, one after another.
    """
    rows = with_chunks(claimed, batch_sizes)
    dealt = rows.repartition("name", "chunk").sortWithinPartitions("name", "chunk", F.col("priority").desc(), "run_at_ms", "id")
    given = handler, frozenset(batch_sizes), max_run_ms

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for outcomes in _called(_pieces(frames, max(calls, 1)), given, calls):
            found += outcomes
            if len(found) >= BATCH:
                yield _rows(found)
                found = []
        yield _rows(found)

    return dealt.mapInPandas(call, OUTCOME)


def _rows(outcomes: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(outcomes, columns=["id", "worker", "kind", "result", "message", "error", "retryable"], dtype=object)


def _starts(frame: pd.DataFrame) -> np.ndarray:
    """Where deliveries begin in rows in order."""
    return np.flatnonzero((frame["name"] != frame["name"].shift()) | (frame["chunk"] != frame["chunk"].shift()))


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames of a partition in order, cut between deliveries: one may go on in the next frame."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        starts = _starts(frame)
        if held and len(frame) and (held[0]["name"].iloc[-1], held[0]["chunk"].iloc[-1]) == (frame["name"].iloc[0], frame["chunk"].iloc[0]):
            starts = starts[1:]
        if len(starts):
            yield pd.concat([*held, frame.iloc[: starts[-1]]], ignore_index=True)
            held, frame = [], frame.iloc[starts[-1] :]
        held.append(frame)
    if held:
        yield pd.concat(held, ignore_index=True)


def _pieces(frames: Iterator[pd.DataFrame], calls: int) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """(rows, where deliveries begin, and the end): whole deliveries, first one by one, so that few slow calls run at once, too, then more and more together, PIECE rows at last."""
    made = 0
    for frame in _whole(frames):
        ends = [*_starts(frame).tolist(), len(frame)] if len(frame) else []
        rows, first = frame.drop(columns="chunk"), 0
        for i, end in enumerate(ends):
            if end - ends[first] >= min(PIECE, 1 + made // calls) or i == len(ends) - 1 > first:
                yield rows.iloc[ends[first] : end], [e - ends[first] for e in ends[first : i + 1]]
                first, made = i, made + 1


def _calls(piece: tuple[pd.DataFrame, list[int]], handler: Callable[[Delivery], object], batched: frozenset[str], max_run_ms: int | None) -> list[tuple]:
    """Rows of OUTCOME that calls for a piece's deliveries end with."""
    rows, ends = piece[0].copy(), piece[1]  # columns of a kind in one block, which is fast to slice
    rows.index = np.arange(len(rows)) - np.repeat(ends[:-1], np.diff(ends))  # each delivery's from 0
    names, ids, workers, found = rows["name"].tolist(), rows["id"].tolist(), rows["worker_id"].tolist(), []
    for a, b in pairwise(ends):
        one = Delivery(names[a], partial(rows.iloc.__getitem__, slice(a, b)), ids[a:b])
        one.run(handler, names[a] in batched, max_run_ms)
        worker = dict(zip(ids[a:b], workers[a:b]))
        found += [(id, worker[id], *outcome) for id, outcome in one.outcomes.items() if id in worker]
    return found


#: What a process that makes calls for a task of the cluster was started with.
_given: tuple = ()


def _start(*given) -> None:
    """Begins a process that makes calls, and ends with the one that started it."""
    global _given
    _given = given
    gc.freeze()  # else collecting garbage would copy what both share
    threading.Thread(target=lambda: (multiprocessing.parent_process().join(), os._exit(1)), daemon=True).start()


def _calls_here(piece: tuple[pd.DataFrame, list[int]]) -> list[tuple]:
    return _calls(piece, *_given)


def _called(pieces: Iterator[tuple[pd.DataFrame, list[int]]], given: tuple, calls: int) -> Iterator[list[tuple]]:
    """What calls for the pieces end with, as it comes; twice as many pieces as calls are held at most."""
    if calls <= 1:
        yield from (_calls(piece, *given) for piece in pieces)
        return
    pool, running = None, set[Future]()
    try:
        for piece in pieces:
            # forked, so that handlers needn't be pickled, and only where there is a call to make
            pool = pool or ProcessPoolExecutor(calls, multiprocessing.get_context("fork"), _start, given)
            running.add(pool.submit(_calls_here, piece))
            if len(running) >= 2 * calls:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                yield from (f.result() for f in done)
        while running:
            done, running = wait(running, return_when=FIRST_COMPLETED)
            yield from (f.result() for f in done)
    finally:
        if pool:
            pool.shutdown(cancel_futures=True)


def settle(tasks: DataFrame, outcomes: DataFrame, now: int, base_ms: int = BACKOFF_MS, max_ms: int = BACKOFF_MAX_MS, random: Column | None = None) -> DataFrame:
    """The tasks that outcomes (OUTCOME, an id at most once) change, as they are afterwards, by one join.

    Only a task whose worker still holds it changes. A result that isn't JSON fails its task for good, an error that isn't a JSON
    object is replaced. A failure that is retryable (or null) waits by the task's own attempts: half of the window and a share `random` (0 to 1) of the rest. Other kinds change nothing.
    """
    rows = _of(tasks, outcomes.where(F.col("kind").isin(COMPLETE, SUCCEED, FAIL)), now)
    bad = F.col("_kind").isin(COMPLETE, SUCCEED) & ~is_json("_result")
    retryable = F.when(bad, False).otherwise(F.coalesce("_retryable", F.lit(True)))
    rows = rows.withColumns({"_kind": F.when(bad, FAIL).otherwise(F.col("_kind")), "_error": F.when(bad, UNSERIALIZABLE).otherwise(F.col("_error")), "_retryable": retryable})
    rows = rows.withColumn("_delay_ms", backoff_delay(F.col("attempt"), base_ms, max_ms, F.rand() if random is None else random, F.col("_retryable")))
    values: dict[str, Column] = {}
    for kind, changed in ((COMPLETE, completed_values(now)), (SUCCEED, succeeded_values(now)), (FAIL, failed_values(now))):
        for column, value in changed.items():
            values[column] = F.when(F.col("_kind") == kind, value).otherwise(values.get(column, F.col(column)))
    return _tasks_only(rows.withColumns(values))


def complete_in(tasks: DataFrame, outcomes: DataFrame, own: dict[str, DataFrame], root: str, version: int, now: int) -> DataFrame:
    """Completes tasks by outcomes (id, worker, result) and writes, as one version, what changes together with the caller's own rows (id, and what they like, by table) of the tasks that this completed.

    Returns the outcomes whose worker had lost its task: of these nothing is written, as of the whole version if its writing doesn't end.
    """
    changes = kept(complete(tasks, outcomes, now))
    write_changes(changes, root, version, {name: rows.join(changes.select("id"), "id", "left_semi") for name, rows in own.items()})
    return outcomes.join(changes.select("id"), "id", "left_anti")

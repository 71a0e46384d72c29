"""Timers of leases and delays: what falls due comes out, with no command coming in.

Each task has one timer: the end of its lease while it runs, or the time that it may run at while it is
queued. It stands in Spark's state store, so that a stream that is started again still has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the state store that timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXPIRE, DUE = "expire", "due"
_OUT = "id string, op string, now_ms long"


class _Timers(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("next", "version long, at long, op string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max((tuple(r) for frame in rows for r in frame[["version", "reason", "run_at_ms", "lease_until_ms"]].itertuples(index=False)), key=lambda r: r[0])
        version, reason, run_at, lease = last
        held = self.state.get() if self.state.exists() else None
        if held is not None and held[0] > version:
            return
        if held is not None and held[2] is not None:
            self.handle.deleteTimer(held[1])
        at, op = (run_at, DUE) if reason == "queued" else (lease, EXPIRE) if reason == "running" else (None, None)
        if at is None or pd.isna(at):
            self.state.update((int(version), -1, None))
            return
        self.state.update((int(version), int(at), op))
        if at <= timerValues.getCurrentProcessingTimeInMs():
            yield self._fallen(key, int(version), op, int(at))
        else:
            self.handle.registerTimer(int(at))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        at = expiredTimerInfo.getExpiryTimeInMs()
        if held is not None and held[2] is not None and held[1] == at:
            yield self._fallen(key, held[0], held[2], at)

    def _fallen(self, key: tuple, version: int, op: str, at: int) -> pd.DataFrame:
        self.state.update((version, -1, None))
        return pd.DataFrame([(key[0], op, at)], columns=["id", "op", "now_ms"])

    def close(self) -> None:
        """Nothing is open."""


def timers(changes: DataFrame) -> DataFrame:
    """(id, op, now_ms) of a stream of changes (id, version, reason, run_at_ms, lease_until_ms; see sources.changes, with the option running): `expire`, a command for the log, when a task's lease ends, and `due` when a queued task may run.

    A later version of a task replaces its timer, and one that has ended has none. The session's state store must be STATE_STORE. now_ms is the time that
    was set, whenever the next micro-batch comes; all before the latest version of a task is forgotten.
    """
    return changes.groupBy("id").transformWithStateInPandas(_Timers(), _OUT, "append", "processingTime")

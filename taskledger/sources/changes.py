"""A streaming source of what changes in a ledger: `queued` when a task becomes queued, `done` when it ends.

Offsets are numbers of versions, and only versions whose writing has ended count; partitions are the files of a version's
changes. A stream that is started again from its checkpoint goes on after the last version that it has read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..plans.versions import CHANGES, PARTS
from ..schema import QUEUED, TERMINAL


@dataclass
class _File(InputPartition):
    path: str
    version: int


class ChangeSource(DataSource):
    """Options: path, the ledger's root; queues, names with commas between, of which `queued` is told (of all if absent; `done` is told of all).

    after: the version to begin after (0). running: true if `running` is told, too.
    """

    @classmethod
    def name(cls) -> str:
        return "ledger_changes"

    def schema(self) -> str:
        return "version int, reason string, queue string, id string, run_at_ms long, lease_until_ms long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChangeReader(self.options)


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.after = options["path"], int(options.get("after", 0))
        self.queues = options["queues"].split(",") if "queues" in options else None
        self.running = options.get("running") == "true"

    def _ended(self) -> list[int]:
        system, root = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        folders = [f for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith(f"{CHANGES}=")]
        marks = system.get_file_info([f"{f.path}/_SUCCESS" for f in folders])
        return sorted(int(f.base_name.split("=")[1]) for f, mark in zip(folders, marks) if mark.type == fs.FileType.File)

    def initialOffset(self) -> dict:
        return {"version": self.after}

    def latestOffset(self) -> dict:
        return {"version": max([self.after, *self._ended()])}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        system, root = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        versions = [n for n in self._ended() if start["version"] < n <= end["version"]]
        selectors = [(n, fs.FileSelector(f"{root}/{CHANGES}={n}/class={part}", allow_not_found=True, recursive=True)) for n in versions for part in PARTS]
        return [_File(f.path, n) for n, s in selectors for f in system.get_file_info(s) if f.base_name.endswith(".parquet")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else fs.LocalFileSystem()
        with system.open_input_file(partition.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=["id", "queue", "status", "run_at_ms", "lease_until_ms"]):
                status, queue = batch.column("status"), batch.column("queue")
                queued = pc.equal(status, QUEUED)
                if self.queues is not None:
                    queued = pc.and_(queued, pc.is_in(queue, pa.array(self.queues, pa.string())))
                done = pc.is_in(status, pa.array(TERMINAL))
                running = pc.equal(status, "running") if self.running else pa.array([False] * len(batch))
                reason = pc.case_when(pc.make_struct(queued, done, running), *map(pa.scalar, ("queued", "done", "running")))
                version = pa.array([partition.version] * len(batch), pa.int32())
                names = ["version", "reason", "queue", "id", "run_at_ms", "lease_until_ms"]
                told = pa.RecordBatch.from_arrays([version, reason, queue, *[batch.column(c) for c in names[3:]]], names=names)
                yield told.filter(pc.is_valid(reason))

    def commit(self, end: dict) -> None:
        """Nothing is kept here: the stream's checkpoint knows."""

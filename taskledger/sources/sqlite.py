"""A Spark data source that reads a table of an existing SQLite file by ranges of rowid.

The file must be reachable under the same path from all executors. Comparisons with values are
left to SQLite, by its indexes, with the option filters=push; Spark asks for
spark.sql.python.filterPushdown.enabled then.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", IsNull: "is null", IsNotNull: "is not null"}


class Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = schema.fieldNames()
        self.path, self.table = options["path"], options["table"]
        self.parts = int(options.get("partitions", 8))

        self.where: list[tuple[str, list]] = []

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if low is None:
            return [Rows(0, 0)]
        step = -(-(high + 1 - low) // self.parts)
        return [Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._open() as db:
            kept = " and ".join(["rowid >= ? and rowid < ?", *(w for w, _ in self.where)])
            yield from db.execute(f'select {names} from "{self.table}" where {kept}', (partition.low, partition.high, *(v for _, values in self.where for v in values)))


class FilteringReader(SqliteReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what SQLite decides as Spark does; yields the rest."""
        for f in filters:
            plain = len(f.attribute) == 1 and f.attribute[0] in self.columns if hasattr(f, "attribute") else False
            values = list(getattr(f, "value", ())) if isinstance(f, In) else [f.value] if hasattr(f, "value") else []
            if not plain or type(f) not in COMPARED or not all(isinstance(v, (int, float, str)) for v in values):
                yield f
                continue
            marks = f"({', '.join('?' * len(values))})" if isinstance(f, In) else "?" * len(values)
            self.where.append((f'"{f.attribute[0]}" {COMPARED[type(f)]} {marks}', values))


class SqliteSource(DataSource):
    """spark.dataSource.register(SqliteSource); spark.read.format("sqlite").schema(...).options(path=, table=, partitions=, filters=).load()"""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("give the schema: spark.read.format('sqlite').schema(...)")

    def reader(self, schema: StructType) -> SqliteReader:
        return (FilteringReader if self.options.get("filters") == "push" else SqliteReader)(schema, self.options)

"""Versions of a table: the rows that changed replace those that were.

A version is either the whole table or the rows that changed since the version before; it is a Parquet folder that
is written once, and its number is the writer's. A folder counts once Spark has marked its
writing as ended; one that a writer has left half-way is written anew.

Other tables, such as keys or a caller's own rows, go into the same write, each as a class of its own: one mark
holds for all, so that all of a version is read or none.

Within a class rows lie in buckets by a hash of their first column, a task's id: whoever asks for some ids reads
the buckets of these alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..schema import TERMINAL

WHOLE, CHANGES = "version", "changes"
#: Classes of tasks.
PARTS = ("live", "terminal")
#: Buckets of each class; those of all versions under a root must be as many.
BUCKETS = 64


def apply_changes(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """tasks with the rows of changes (the same columns, an id at most once) in place of those with their ids; new ids are added."""
    return tasks.join(changes.select("id"), "id", "left_anti").unionByName(changes.select(*tasks.columns))


def drop_purged(tasks: DataFrame, keys: DataFrame, purged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tasks and keys without purged ids and the keys that point to them."""
    return tasks.join(purged, "id", "left_anti"), keys.join(purged.select(F.col("id").alias("task_id")), "task_id", "left_anti").select(*keys.columns)


def ended(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the versions of a kind whose writing has ended, by Spark's own mark in their folders, rising."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def latest_version(spark: SparkSession, root: str) -> int | None:
    return max(ended(spark, root, WHOLE) + ended(spark, root, CHANGES), default=None)


def bucket_of(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(BUCKETS)).cast("int")


def _class():
    return F.when(F.col("status").isin(*TERMINAL), "terminal").otherwise("live")


def _write(rows: DataFrame, root: str, kind: str, version: int, others: dict[str, DataFrame] | None = None) -> None:
    if version in ended(rows.sparkSession, root, kind):
        raise ValueError(f"{kind} {version} is there already")
    for name, table in (others or {}).items():
        if not name.isidentifier() or name in PARTS:
            raise ValueError(f"a table can't be named {name!r}")
        place = F.lit(name).alias("class"), bucket_of(table.columns[0]).alias("bucket")
        rows = rows.unionByName(table.select(*place, *[F.col(c).alias(f"{name}:{c}") for c in table.columns]), allowMissingColumns=True)
    if others or kind == CHANGES:  # else each task would write a file to each bucket
        rows = rows.hint("rebalance", "class", "bucket")
    rows.write.mode("overwrite").partitionBy("class", "bucket").parquet(f"{root}/{kind}={version}")


def write_version(tasks: DataFrame, root: str, version: int, others: dict[str, DataFrame] | None = None) -> None:
    """The whole table, and other whole tables by name.

    Live and terminal tasks lie apart, so that claims, probes and recovery scan live ones only and purges the others. Spark cuts either into files of like size.
    """
    apart = tasks.withColumns({"class": _class(), "bucket": bucket_of("id")}).hint("rebalance", "class", "bucket")
    _write(apart.sortWithinPartitions("class", "bucket", "queue", "status", F.col("priority").desc(), "run_at_ms", "id"), root, WHOLE, version, others)


def write_changes(changes: DataFrame, root: str, version: int, others: dict[str, DataFrame] | None = None) -> None:
    """The rows (an id at most once) that differ from the version before, and rows of other tables by name."""
    _write(changes.withColumns({"class": _class(), "bucket": bucket_of("id")}), root, CHANGES, version, others)


def _since(spark: SparkSession, root: str, version: int) -> tuple[int, list[int]]:
    """The last whole version up to this one, and the changes since; an error if there is no such version."""
    base = max((n for n in ended(spark, root, WHOLE) if n <= version), default=None)
    since = [n for n in ended(spark, root, CHANGES) if (base is None or n > base) and n <= version]
    if base is None or max([base, *since]) != version:
        raise ValueError(f"no version {version}")
    return base, since


def _in_buckets(only: DataFrame | None) -> Column:
    """Whether a row lies in a bucket of the ids in only's one column; all do if there is none. BUCKETS numbers at most reach the driver."""
    if only is None:
        return F.lit(True)
    return F.col("bucket").isin([r.b for r in only.select(bucket_of(only.columns[0]).alias("b")).distinct().collect()])


def read_table(spark: SparkSession, root: str, version: int, name: str, schema: StructType, by: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """Another table as of the version: with `by`, the latest row of each value of that column; else all rows that versions up to this one have put in by changes.

    only: a column of values of the table's first column, to read the buckets of these alone, and these rows.
    """
    base, since = _since(spark, root, version)
    stored = StructType([StructField(f"{name}:{f.name}", f.dataType) for f in schema]).add("class", "string").add("bucket", "integer")
    here, key = _in_buckets(only), schema.fieldNames()[0]

    def rows(kind: str, n: int) -> DataFrame:
        found = spark.read.schema(stored).parquet(f"{root}/{kind}={n}").where((F.col("class") == name) & here)
        if only is not None:
            found = found.join(only.select(F.col(only.columns[0]).alias("_key")), F.col(f"`{name}:{key}`") == F.col("_key"), "left_semi")
        return found.select(*[F.col(f"`{name}:{c}`").alias(c) for c in schema.fieldNames()])

    if by is None:
        parts = [rows(CHANGES, n) for n in ended(spark, root, CHANGES) if n <= version]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    latest = rows(WHOLE, base)
    if since:
        changed = reduce(DataFrame.unionByName, [rows(CHANGES, n).withColumn("_n", F.lit(n)) for n in since])
        last = changed.groupBy(by).agg(F.max_by(F.struct(*schema.fieldNames()), "_n").alias("_row")).select("_row.*")
        latest = latest.join(last.select(by), by, "left_anti").select(*schema.fieldNames()).unionByName(last)
    return latest


def read_version(spark: SparkSession, root: str, version: int, schema: StructType, part: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """The version, or its live or terminal part alone: the last whole table up to it, and what changed since, the latest row of each id.

    only: a column of ids, to read their buckets alone, and these tasks.
    """
    base, since = _since(spark, root, version)
    full = StructType([*schema.fields]).add("class", "string").add("bucket", "integer")
    buckets = _in_buckets(only)

    def stored(kind: str, n: int) -> DataFrame:
        found = spark.read.schema(full).parquet(f"{root}/{kind}={n}").where(buckets)
        return found if only is None else found.join(only.select(F.col(only.columns[0]).alias("id")), "id", "left_semi")

    def here(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("class").isin(*PARTS) if part is None else F.col("class") == part)

    rows = here(stored(WHOLE, base))
    if since:
        changed = reduce(DataFrame.unionByName, [stored(CHANGES, n).where(F.col("class").isin(*PARTS)).withColumn("_n", F.lit(n)) for n in since])
        last = changed.groupBy("id").agg(F.max_by(F.struct(*full.fieldNames()), "_n").alias("_row")).select("_row.*")
        rows = rows.join(last.select("id"), "id", "left_anti").select(*full.fieldNames()).unionByName(here(last))
    return rows.select(*schema.fieldNames())

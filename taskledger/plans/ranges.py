"""Numbers and sums over the rows of a group in order, where one group may be most of the table."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: So many groups in ranges are broadcast to their rows at most.
FEW = 20_000
#: Rows of a group that make it many ranges in placed(), at least; rows that tell such groups, for each partition.
MANY, SEEN = 100_000, 200


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, from spark.checkpoint.dir. Local mode makes a folder of its own if none is set; on a cluster that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df in the session's checkpoint folder, so that what follows sees the same rows in the same partitions each time."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Sequence[str] = (), near: Sequence[str] = (), after: bool = False) -> DataFrame:
    """rows with `place`, from 0 within each group (nulls are a group) in an order without ties.

    sums: columns whose sums over the group's rows before are `before_<c>`. near: columns whose values in the group's first row
    are `first_<c>`, and in the row before `last_<c>`; with `after`, in the row after `next_<c>`.

    Rows are dealt out in ranges of group and order, so that a large group is many ranges; each is numbered apart, and a row for each group in a range says what comes before.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not sums and not near:
        return _placed(rows, by, order, partitions)
    ranged = kept(rows.repartitionByRange(partitions, *by, *order).withColumn("_range", F.spark_partition_id()))
    given = {"place": F.lit(1).cast("long")} | {f"before_{c}": F.col(c) for c in sums}
    ends = [F.first("_first").alias("_first"), F.last("_last").alias("_last")] if near else []
    within = Window.partitionBy(*by, "_range").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    values = F.struct(*near) if near else F.lit(None)
    every = ranged.withColumns({f"_{k}": F.coalesce(F.sum(v).over(before), F.lit(0)) for k, v in given.items()})
    if near:
        whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        every = every.withColumns({"_last_one": F.lag(values).over(within), "_next_one": F.lead(values).over(within), "_first": F.first(values).over(within), "_last": F.last(values).over(whole)})
    counts = every.groupBy(*by, "_range").agg(*[F.sum(v).alias(k) for k, v in given.items()], *ends)
    earlier = Window.partitionBy(*by).orderBy("_range")
    offsets = [F.coalesce(F.sum(k).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_more_{k}") for k in given]
    offsets += [F.first("_first").over(earlier).alias("_begin"), F.lag("_last").over(earlier).alias("_end"), F.lead("_first").over(earlier).alias("_after")] if near else []
    counts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_in"), *offsets)
    found = every.drop("_first", "_last").join(counts, _same(by))
    new = {k: F.col(f"_{k}") + F.col(f"_more_{k}") for k in given}
    for c in near:
        new |= {f"first_{c}": F.col(f"_begin.{c}"), f"last_{c}": F.when(F.col("_place") > 0, F.col(f"_last_one.{c}")).otherwise(F.col(f"_end.{c}"))}
        if after:
            new[f"next_{c}"] = F.coalesce("_next_one", "_after")[c]
    return found.select(*rows.columns, *[v.alias(k) for k, v in new.items()])


def _same(by: Sequence[str]) -> Column:
    """Whether a row is of a group in a range."""
    same = F.col("_range") == F.col("_in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return same


def _placed(rows: DataFrame, by: Sequence[str], order: Sequence[Column], partitions: int) -> DataFrame:
    """rows with `place` alone: rows are counted as they lie sorted in their range, so that they aren't dealt out by group and range, too."""
    lie = {"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}
    ranged = kept(rows.repartitionByRange(partitions, *by, *order).sortWithinPartitions(*by, *order).withColumns(lie))
    counts = ranged.groupBy(*by, "_range").agg(F.min("_row").alias("_start"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start")
    counts = kept(counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_in"), shift.alias("_shift")))
    if counts.count() <= FEW:
        counts = F.broadcast(counts)
    return ranged.join(counts, _same(by)).select(*rows.columns, (F.col("_row") + F.col("_shift")).alias("place"))


def crowded(rows: DataFrame, by: str) -> list:
    """Values of a column that are likely to have more rows than an even partition, and over MANY: fewer than there are partitions. A share of the rows tells them."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    if n <= MANY:
        return []
    share = min(1.0, SEEN * partitions / n)
    counts = rows.select(by).sample(share, 0).groupBy(by).count()
    return [r[0] for r in counts.where(F.col("count") > share * max(MANY, n / partitions)).collect()]


def placed(rows: DataFrame, by: str, order: Sequence[Column], near: Sequence[str]) -> DataFrame:
    """rows with `place`, from 0 within each group (nulls are a group) in an order without ties, and `first_<c>`, `last_<c>` and `next_<c>` for columns near: their values in the group's first row, in the row before and in the row after.

    For groups without number: rows are dealt out by group, once, but for groups that are crowded(), whose rows are dealt out in ranges by numbered(). Which groups these are decides only where rows lie.
    """
    own = Window.partitionBy(by).orderBy(*order)
    new = {"place": F.row_number().over(own).cast("long") - 1}
    for c in near:
        new |= {f"first_{c}": F.first(c).over(own), f"last_{c}": F.lag(c).over(own), f"next_{c}": F.lead(c).over(own)}
    many = crowded(rows, by)
    if not many:
        return rows.withColumns(new)
    among = reduce(or_, [F.col(by).eqNullSafe(F.lit(v)) for v in many])
    hot = numbered(rows.where(among), [by], order, near=near, after=True)
    return rows.where(~among).withColumns(new).unionByName(hot)

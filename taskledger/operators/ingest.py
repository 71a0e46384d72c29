"""Submissions from outside: ids as columns, and a split into rows that may go in and rows that are set aside with the reason."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import ALPHABET, is_json
from ..plans.ranges import kept
from ..schema import CONFLICTS


def id_of(ms: Column, high: Column, low: Column) -> Column:
    """task_ and 26 characters that order by time: 48 bits of milliseconds, then two numbers of 40 bits."""

    def digits(value: Column, n: int) -> list[Column]:
        return [F.substring(F.lit(ALPHABET), F.shiftright(value, 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(n - 1, -1, -1)]

    time = ms.cast("long").bitwiseAND((1 << 48) - 1)
    return F.concat(F.lit("task_"), *digits(time, 10), *digits(high.cast("long"), 8), *digits(low.cast("long"), 8))


def with_ids(rows: DataFrame, now: int | Column, column: str = "id") -> DataFrame:
    """rows with a new id in `column`. The ids are random, and so kept in the checkpoint folder: a task of the cluster that is run again makes no others."""

    def bits(seed: int | None) -> Column:
        return F.floor(F.rand() * float(1 << 40)).cast("long")

    return kept(rows.withColumn(column, id_of(now if isinstance(now, Column) else F.lit(now), bits(0), bits(1))))


class Ingested(NamedTuple):
    """Rows that may go in, as they came, and others with `reason`."""

    valid: DataFrame
    quarantined: DataFrame


def ingest(rows: DataFrame) -> Ingested:
    """Splits submissions (what insert_tasks takes, and perhaps conflict) in place of ending the query with the first bad row. Documents stay as they are, byte for byte.

    reason is the first that holds of: no name; payload or metadata that isn't JSON (NaN isn't), or no payload; metadata that isn't an object; under one
    attempt; a negative delay; an unknown conflict strategy.
    """

    def given(c: str) -> Column:
        return F.col(c) if c in rows.columns else F.lit(None)

    faults = [
        ("name", F.coalesce(given("name").cast("string"), F.lit("")) == ""),
        ("payload", F.col("payload").isNull() | ~is_json("payload")),
        ("metadata", ~is_json(given("metadata").cast("string"))),
        ("metadata_object", ~given("metadata").cast("string").rlike(r"^\s*\{")),
        ("max_attempts", given("max_attempts").cast("int") < 1),
        ("delay_ms", given("delay_ms").cast("long") < 0),
        ("conflict", ~given("conflict").cast("string").isin(*CONFLICTS)),
    ]
    reason = F.lit(None).cast("string")
    for name, fault in reversed(faults):
        reason = F.when(F.coalesce(fault, F.lit(False)), name).otherwise(reason)
    judged = rows.withColumn("reason", reason)
    return Ingested(judged.where("reason is null").drop("reason"), judged.where("reason is not null"))

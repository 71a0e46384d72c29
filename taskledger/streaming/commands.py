"""A stream of commands applied to a task table: each micro-batch is folded, and the rows that change become a version.

A version carries the number of the batch that made it. A batch that is run again, after a failure
or a restart, finds its version there and changes nothing: commands are applied exactly once. One
whose writing had not ended is written anew. Every so many batches the whole table is written, so
that a version is read from one table and few changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fold import ARGUMENTS, SUBMISSION, SUBMIT, _with, fold_log
from ..plans import latest_version, read_table, read_version, write_changes, write_version
from ..plans.ranges import kept
from ..plans.versions import WHOLE, ended
from ..schema import KEY_SCHEMA, TASK_SCHEMA

COMMAND_SCHEMA = "id string, seq long, " + ", ".join(f"{k} {t}" for k, t in ARGUMENTS.items())
#: Of streams with keyed submissions among the commands.
LOG_SCHEMA = f"{COMMAND_SCHEMA}, " + ", ".join(f"{k} {t}" for k, t in SUBMISSION.items())
#: Batches after which the whole table is written.
COMPACT = 16


def apply_stream(commands: DataFrame, root: str, checkpoint: str, lease_ms: int = 30_000, delay_ms: int = 1_000, compact: int = COMPACT, **trigger) -> StreamingQuery:
    """Starts the stream; version 0 under root is the table that it begins with, version n + 1 that after batch n.

    A batch reads the buckets of the tasks and keys that it touches. Tasks and keys (table `keys`) are of one version, which is there whole or not at all. Commands that changed nothing, those of unknown tasks or without
    a time among them, are counted by id under root/lost=<version>; what became of submissions is under root/decisions=<version>.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark, version = batch.sparkSession, number + 1
        if (latest_version(spark, root) or 0) < version:
            asked = _with(batch.where(F.col("op") == SUBMIT), SUBMISSION).select("key").distinct()
            own = kept(read_table(spark, root, number, "keys", KEY_SCHEMA, by="key", only=asked))
            touched = read_version(spark, root, number, TASK_SCHEMA, only=batch.select("id").union(own.select("task_id")).distinct())
            folded = fold_log(touched, own, batch, lease_ms, delay_ms)
            folded.lost.write.mode("overwrite").parquet(f"{root}/lost={version}")
            folded.decisions.write.mode("overwrite").parquet(f"{root}/decisions={version}")
            write_changes(folded.changes, root, version, {"keys": _pointed(folded.decisions, own)})
        if version % compact == 0 and version not in ended(spark, root, WHOLE):
            write_version(read_version(spark, root, version, TASK_SCHEMA), root, version, {"keys": read_table(spark, root, version, "keys", KEY_SCHEMA, by="key")})

    return commands.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _pointed(decisions: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of keys as the batch leaves them: those that a submission has pointed to its task."""
    made = decisions.where("decision = 'insert' and key is not null").groupBy("key").agg(F.max_by(F.struct("task_id", "now_ms"), "seq").alias("to"), F.min("now_ms").alias("first"))
    both = made.join(keys.select("key", "created_at_ms"), "key", "left")
    return both.select("key", "to.task_id", F.coalesce("created_at_ms", "first").alias("created_at_ms"), F.col("to.now_ms").alias("updated_at_ms"))

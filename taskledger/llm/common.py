"""What several operators share: reading, lineage cuts, joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, from spark.checkpoint.dir.

    Where that is unset, local mode (tests), whose tasks all share one machine, gets a temporary
    folder; on a cluster it is an error, for no folder of one machine outlives its executor.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the checkpoint folder that all executors share: for small tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet to the checkpoint folder and read again: for large tables that are read more than once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than this share of the rows of a join is joined by broadcast: so many keys there are at most.
HOT_KEYS = 1_000


def join_skewed(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left and right's columns, inner, on `key` (not null); right has one row a key and `n`, its rows in left; total: rows in left.

    Keys with over a thousandth of left's rows, a thousand at most, are broadcast, so that their rows stay
    where they are; all others are shuffled. Both inputs are read twice.
    """
    bound = max(1, total // HOT_KEYS)
    hot = F.broadcast(right.where(F.col("n") > bound).drop("n"))
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col("n") <= bound).drop("n"), key)
    return left.join(hot, key).unionByName(cold)


def join_salted(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """left and right's columns, inner, on `keys` (not null); right has one row a key, of any size; counts: keys and `n`, their rows in left.

    Keys with over a thousandth of left's rows, a thousand at most, are dealt out over salts: of those
    keys alone, with their numbers of salts, is a broadcast.
    """
    bound = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(counts.where(F.col("n") > bound).select(*keys, F.ceil(F.col("n") / bound).cast("int").alias("_salts")))
    spread = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.col("_salts"))).otherwise(0)
    asks = left.join(hot, keys, "left").withColumn("_salt", spread.cast("int")).drop("_salts")
    holds = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return asks.join(holds, [*keys, "_salt"]).drop("_salt")


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): whatever else docs carries can't clash with an operator's columns. A null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Rows of Spark's Arrow batches that are taken together.
ROWS_AT_ONCE = 256


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in order, ROWS_AT_ONCE at most at a time: what is made of them is small, however many rows Spark sends together.

    After the last, Arrow's pool gives back what it holds unused: Python workers live on from task to
    task and stage to stage, and so would that memory.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)
    batch = None
    pa.default_memory_pool().release_unused()


def partitions(df: DataFrame) -> int:
    """Shuffle partitions that the session asks for, for repartition() by an expression."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hex64(value: Column) -> Column:
    """A long as 16 lowercase hexadecimal digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def word_count(text: Column) -> Column:
    """Number of maximal runs free of ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Bytes of text under one id, about, from which its rows are dealt to parts.
CROWDED_BYTES = 1_000_000
#: Stands for a null id.
LEAST_ID = -(2**63)


def crowded_ids(texts: DataFrame, bound: int = CROWDED_BYTES) -> DataFrame:
    """(doc_id, parts) of ids whose rows of texts (doc_id, text) hold more than `bound` bytes together; a null id is LEAST_ID."""
    known = texts.select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("doc_id"), F.octet_length("text").cast("long").alias("bytes"))
    sizes = known.groupBy("doc_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > bound) & (F.col("n") > 1))
    return written(sizes.select("doc_id", F.ceil(F.col("bytes") / bound).cast("int").alias("parts")), "crowded")


def in_parts(texts: DataFrame, crowded: DataFrame) -> DataFrame:
    """texts (doc_id, text) with `none`, whether the id is null, LEAST_ID in its place, and `part`: 0, but for crowded ids a number by the text.

    So (doc_id, part) is a key that no id makes hot, unless by rows that agree in text. Spark broadcasts the
    crowded ids if they are few, and joins them by a shuffle if they aren't.
    """
    known = texts.withColumns({"none": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(LEAST_ID))})
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("text"), F.col("parts"))).cast("int")
    return known.join(crowded, "doc_id", "left").withColumn("part", part).drop("parts")

"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are permuted by a hash and cut into BLOCKS blocks of the hash's leading bits.
Its target asks for so many passes over all its blocks and a last one up to a cut; the blocks of
all passes are its quota. The tree halves the output shards again and again, and at each node
draws, without replacement, how many of each source's blocks go left: first for groups of sources,
then, in each group, for its sources. Leaves hold exact quotas: each shard draws its run of the
source's permuted blocks, and orders its documents by a hash. What the mix takes of a document
is what the shards have drawn of its block. Only sums over sources and blocks are shuffled to get
there; documents aren't.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, join_skewed, partitions, word_count

#: Weights of sources in order, repeating; the mix's size as a share of all; the most that a source gives, as a share of it.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Hexadecimal digits of the hash that name a block.
BLOCK_DIGITS = 3
BLOCKS = 16**BLOCK_DIGITS
#: Output shards, unless given: one for so many words of the mix, within these bounds.
SHARD_WORDS, LEAST_SHARDS, MOST_SHARDS = 1 << 21, 16, 256
#: Groups of sources that the tree first splits.
GROUPS = 256
SEED = 7
#: Up to so many bytes the sources' plans are broadcast; beyond, only those of sources with many documents are, and the others are joined.
BROADCAST_BYTES = 64_000_000


def permutation_key(seed: int = SEED) -> Column:
    """Hash by which a source's documents are permuted. Equal rows have equal keys."""
    identity = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return F.md5(identity.cast("binary"))


def _in_order(rows: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """rows with `place`, from 0 by a total order, and `before_<c>`, the sum of c over all rows before: ranges are sorted apart, and one row a range says what comes before it."""
    ranged = cut_lineage(rows.repartitionByRange(partitions(rows), *order).withColumn("_range", F.spark_partition_id()))
    given = {"place": F.lit(1).cast("long")} | {f"before_{c}": F.col(c) for c in sums}
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = ranged.groupBy("_range").agg(*[F.sum(v).alias(k) for k, v in given.items()])
    offsets = offsets.select("_range", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in given])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumns({k: F.coalesce(F.sum(v).over(within), F.lit(0)) for k, v in given.items()}).join(F.broadcast(offsets), "_range")
    return found.withColumns({k: F.col(k) + F.col(f"_{k}") for k in given}).drop("_range", *[f"_{k}" for k in given])


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank from 1) with `target`: sources by code point, null last, take WEIGHTS of SHARE of all, MOST of their size at most, the excess going to the others.

    The common level is where the first source, by how soon it is full, isn't full.
    """
    by_name = F.col("source").asc_nulls_last()
    ranked = _in_order(sizes, [by_name]).withColumn("rank", F.col("place") + 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(MOST)).drop("place")
    ranked = cut_lineage(_in_order(ranked, [F.col("most") / F.col("weight"), by_name], ("most", "weight")))
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(whole.words or 0)) * F.lit(SHARE) - F.col("before_most")) / (F.lit(float(whole.weight or 0)) - F.col("before_weight"))
    first = ranked.withColumn("level", level).where(F.col("level") <= F.col("most") / F.col("weight")).agg(F.min(F.struct("place", "level")).alias("fits")).first().fits
    target = F.least("most", F.lit(first.level) * F.col("weight")) if first else F.col("most")
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def even(total: int, shards: int) -> np.ndarray:
    """Blocks of each shard, as even as can be: each node of the tree halves them."""
    ends = np.zeros(shards, np.int64)

    def split(low: int, high: int, n: int) -> None:
        if high - low == 1:
            ends[low] = n
            return
        middle = (low + high) // 2
        left = n * (middle - low) // (high - low)
        split(low, middle, left)
        split(middle, high, n - left)

    split(0, shards, total)
    return ends


def split_tree(blocks: np.ndarray, room: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Blocks of each source in each shard: a (sources, shards) table whose rows sum to `blocks` and whose columns sum to `room`."""
    out = np.zeros((len(blocks), len(room)), np.int64)

    def split(low: int, high: int, counts: np.ndarray) -> None:
        if high - low == 1:
            out[:, low] = counts
            return
        middle, total = (low + high) // 2, int(counts.sum())
        go = int(room[low:middle].sum())
        left = np.zeros_like(counts)
        for s, n in enumerate(counts.tolist()):  # one hypergeometric draw a source, given what is left
            rest = total - n
            left[s] = n if go >= total else 0 if go == 0 else _hypergeometric(draw, n, rest, go)
            total, go = rest, go - int(left[s])
        split(low, middle, left)
        split(middle, high, counts - left)

    split(0, len(room), blocks.astype(np.int64))
    return out


def _hypergeometric(draw: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if good + bad < 10**9:
        return int(draw.hypergeometric(good, bad, sample))
    mean = sample * good / (good + bad)  # beyond numpy's range: normal with the same mean and spread
    spread = np.sqrt(mean * (bad / (good + bad)) * ((good + bad - sample) / max(1, good + bad - 1)))
    return int(np.clip(round(draw.normal(mean, spread)), max(0, sample - bad), min(good, sample)))


def _leaves(plans: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, ends) of plans (rank, quota): the running quota of the shards that the tree gives the source.

    Groups of sources are split first, a number each; then each group splits its sources within the room that it has in each shard.
    """
    grouped = plans.select("rank", "quota", F.pmod("rank", F.lit(GROUPS)).cast("int").alias("group"))
    counts = np.zeros(GROUPS, np.int64)
    for r in grouped.groupBy("group").agg(F.sum("quota").alias("quota")).collect():  # GROUPS rows at most
        counts[r.group] = r.quota
    rooms = split_tree(counts, even(int(counts.sum()), shards), np.random.default_rng(seed))

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        group = int(rows["group"][0])
        drawn = split_tree(rows["quota"].to_numpy(), rooms[group], np.random.default_rng([seed, group]))
        return pd.DataFrame({"rank": rows["rank"], "ends": drawn.cumsum(1).tolist()})

    return grouped.groupBy("group").applyInPandas(split, "rank long, ends array<long>")


def _with_key(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumns({"_size": word_count(F.col("text")), "_key": permutation_key(seed)})


def _named(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_plans(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """A row for each source: source_size, target, n_docs, cut (key up to which the last pass goes), part (words of each document at the cut), cut_block (place among all passes' blocks), and ends (running quota of the shards)."""
    digits = [F.substring("_key", 1 + BLOCK_DIGITS * i, BLOCK_DIGITS).alias(f"d{i}") for i in range(2)]
    sizes = cut_lineage(_with_key(docs.select("doc_id", "source", "text"), seed).groupBy("source", *digits, F.col("_key").alias("key")).agg(F.sum("_size").alias("words"), F.count("*").alias("n")))
    blocks = sizes.groupBy("source", "d0").agg(F.sum("words").alias("words"), F.sum("n").alias("n"))
    goals = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size"))).join(blocks.groupBy(F.col("source").alias("_source")).agg(F.sum("n").alias("n_docs")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    goals = goals.withColumn("goal", F.floor(F.col("target") + 0.5)).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0))
    goals = cut_lineage(goals.withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size")))

    # where the last pass ends: in which block, in which part of it, and at which key; one row a source
    reached = goals.select("rank", F.col("source").alias("_source"), "rest", F.lit(0).cast("long").alias("start"))
    for i, by in enumerate(("d0", "d1", "key")):
        known = [f"d{k}" for k in range(i)]
        rows = sizes.groupBy("source", *known, by).agg(F.sum("words").alias("words"), F.sum("n").alias("n")) if by != "key" else sizes.select("source", *known, by, "words", "n")
        here = reached.withColumnsRenamed({k: f"_{k}" for k in known})
        same = F.col("source").eqNullSafe(F.col("_source"))
        for k in known:
            same = same & (F.col(k) == F.col(f"_{k}"))
        up_to = F.col("start") + F.sum("words").over(Window.partitionBy("rank").orderBy(by))
        near = rows.join(here, same).withColumn("to", up_to).withColumn("from", F.col("to") - F.col("words")).where((F.col("rest") >= F.col("from")) & (F.col("rest") < F.col("to")))
        reached = cut_lineage(near.select("rank", "_source", "rest", F.col("from").alias("start"), *known, by, *["n"] * (by == "key")))
    cut = reached.select("rank", F.col("key").alias("cut"), F.floor((F.col("rest") - F.col("start")) / F.col("n")).alias("part"), (F.conv("d0", 16, 10).cast("long")).alias("last"))
    plans = goals.join(cut, "rank", "left").withColumn("last", F.when(F.col("rest") > 0, F.col("last")))
    plans = plans.withColumn("quota", F.col("passes") * BLOCKS + F.coalesce(F.col("last") + 1, F.lit(0)))
    plans = cut_lineage(plans.withColumn("cut_block", F.col("passes") * BLOCKS + F.col("last")))  # a row a source, read twice
    if shards is None:
        words = plans.agg(F.sum("target")).first()[0] or 0
        shards = int(min(MOST_SHARDS, max(LEAST_SHARDS, words // SHARD_WORDS)))
    return cut_lineage(plans.drop("quota").join(_leaves(plans, shards, seed), "rank"))


def _planned(docs: DataFrame, shards: int | None, seed: int) -> DataFrame:
    """docs with _size, _key, the plan of their source as _plan, _drawn, an array of (shard, words) for each time that a shard has drawn the document's block and the pass reaches the document, and _taken."""
    plans = source_plans(docs, shards, seed)
    size = plans.agg(F.count("*").alias("n"), F.max(F.size("ends")).alias("shards"), F.sum("n_docs").alias("docs")).first()
    plan = plans.select(_named(F.col("source")).alias("_name"), F.struct(*plans.columns).alias("_plan"), F.col("n_docs").alias("n"))
    rows = _with_key(docs, seed).withColumn("_name", _named(F.col("source")))
    if size.n * (8 * (size.shards or 0) + 200) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(plan.drop("n")), "_name")
    else:
        rows = join_skewed(rows, plan, "_name", size.docs)
    block = F.conv(F.substring("_key", 1, BLOCK_DIGITS), 16, 10).cast("long")

    def drawn(number: Column) -> Column:
        """Of pass `number`: the shard whose run of blocks holds the document's, or null beyond the quota, and the words that are taken."""
        at = number * BLOCKS + block
        shard = F.size(F.filter("_plan.ends", lambda end: end <= at))
        words = F.when(at < F.coalesce("_plan.cut_block", at + 1), F.col("_size")).when(F.col("_key") < F.col("_plan.cut"), F.col("_size")).when(F.col("_key") == F.col("_plan.cut"), F.col("_plan.part")).otherwise(0)
        return F.struct(F.when(at < F.element_at("_plan.ends", -1), shard).alias("shard"), words.cast("long").alias("words"), number.alias("number"))

    passes = F.transform(F.sequence(F.lit(0), F.floor(F.lit(MOST)).cast("int")), drawn)  # never more than MOST times
    rows = rows.withColumn("_drawn", F.filter(passes, lambda d: d["shard"].isNotNull()))
    return rows.withColumn("_taken", F.aggregate("_drawn", F.lit(0).cast("long"), lambda a, d: a + d["words"]))


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs (doc_id, source, text).

    size: words of the text, none if null. taken: words that all shards take, repeats counted, never
    over twice the size; over a source they sum to its target, rounded, less at most one word for
    each row equal to the one at the cut. A null source is a source. Equal rows take alike. Reruns
    and other partitions give the same. An empty table gives no rows; without any words all is zero.
    """
    return _planned(docs.select("doc_id", "source", "text"), shards, seed).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_size").alias("size"), F.col("_plan.source_size").alias("source_size"), F.col("_plan.target").alias("target"), F.col("_taken").alias("taken")
    )


def mixed_documents(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix: docs' columns, with _shard and _place, a row for each time that a shard takes a document with words; at its source's cut a text ends after the words taken.

    A cut text keeps its characters up to there, and n_chars, if there, is their number. _place
    orders a shard at random; in_shards() lays the rows out so.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # apart from the columns made here
    rows = _planned(docs.select("doc_id", "source", "text", row), shards, seed)
    rows = rows.withColumn("_one", F.explode(F.filter("_drawn", lambda d: d["words"] > 0)))
    is_cut = F.col("_one.words") < F.col("_size")
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_one.words").cast("int")), "")
    kept = {c: F.col(f"row.`{c}`") for c in docs.columns}
    kept["text"] = F.when(is_cut, words).otherwise(F.col("text"))
    if "n_chars" in kept:
        kept["n_chars"] = F.when(is_cut, F.length(words).cast(docs.schema["n_chars"].dataType)).otherwise(kept["n_chars"])
    return rows.select(*[v.alias(k) for k, v in kept.items()], F.col("_one.shard").alias("_shard"), F.xxhash64(F.lit(seed), "_key", "_one.number").alias("_place"))


def in_shards(mixed: DataFrame) -> DataFrame:
    """Rows of mixed_documents() shard by shard, each in its random order. Where the session has more partitions than there may be shards, a shard is several tasks, each with a run of that order; sorting spills."""
    parts = -(-partitions(mixed) // MOST_SHARDS)
    run = F.least(F.floor((F.col("_place").cast("double") / 2.0**64 + 0.5) * parts), F.lit(parts - 1)).cast("int")
    return mixed.withColumn("_part", run).repartition("_shard", "_part").sortWithinPartitions("_shard", "_part", "_place").drop("_part")

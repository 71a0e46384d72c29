"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_skewed


#: Edges that a round's tasks read, about: small graphs aren't dealt out over all shuffle partitions.
EDGES_A_TASK = 4_096


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row.n, row.x, row.s


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node reachable.

    edges: two columns of one orderable type. Loops, repeats and either direction are allowed;
    rows with a null end are ignored. No edges: no rows. Each round is two joins whose minima are
    combined before the shuffle; rounds grow with the logarithm of the longest path, and each is
    cut by a checkpoint. Only three numbers a round reach the driver.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    state = cut_lineage(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _digest(state)
    while before[0]:
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        # each node's larger neighbours move to its smallest neighbour; a star's centre is a hot key
        large = join_skewed(both, least, "u", 2 * before[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # each node and its smaller neighbours move to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        state = cut_lineage(
            join_skewed(large, small, "u", 2 * before[0])
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .distinct()
            .coalesce(1 + before[0] // EDGES_A_TASK)  # rounds add no edges
        )
        now = _digest(state)
        if now == before:
            break
        before = now
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))

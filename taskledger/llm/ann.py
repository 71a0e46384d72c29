"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised by codebooks of their own; a pair of centroids is a cell.
A query walks the cells by the sum of both halves' distances (the inner product, negated), the
nearest first, with a heap, until the cells so far hold enough vectors; these are reranked by the
exact inner product. How many are enough is measured: for sample queries, whose neighbours are
found by brute force, the walk must pass enough vectors to reach the wanted recall.

Equal vectors are one entry, with the smallest of their ids: as many as a result can need.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: Vectors that codebooks are fitted to, at most, and sample queries by which the walk's length is set; those of least hash.
MAX_TRAIN, SAMPLE_QUERIES = 20_000, 200
#: Centroids of a half: a sixteenth of the square root of the entries, within these bounds. The table of cells, which tasks get, has their square: 8 MB at most.
LEAST_CENTROIDS, MOST_CENTROIDS = 16, 1_024
#: Recall that the walk is set for on sample queries, above the 0.9 that is promised.
RECALL = 0.96
#: Entries, and queries, that meet in one group at most, about.
GROUP = 4096
STEPS = 12
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _nearest(vectors[:, :half], self.first), _nearest(vectors[:, half:], self.second)

    def walk(self, query: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """Occupied cells in order of summed distance until they hold `enough` vectors."""
        half = self.first.shape[1]
        near, far = -(self.first @ query[:half]), -(self.second @ query[half:])
        a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
        near, far = near[a], far[b]
        heap, found, held = [(near[0] + far[0], 0, 0)], [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            n = counts[a[i], b[j]]
            if n:
                found.append((int(a[i]), int(b[j])))
                held += int(n)
            if j + 1 < len(b):
                heapq.heappush(heap, (near[i] + far[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):  # each pair enters once: along a row, and down the first column
                heapq.heappush(heap, (near[i + 1] + far[0], i + 1, 0))
        return found


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(1) - 2 * vectors @ centroids.T).argmin(1)


def _fit(vectors: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster is put on a vector chosen at random."""
    draw = np.random.default_rng(seed)
    k = min(k, len(vectors))
    centroids = vectors[draw.permutation(len(vectors))[:k]]
    for _ in range(STEPS):
        of = _nearest(vectors, centroids)
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, vectors)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], vectors[draw.integers(len(vectors), size=k)])
    return centroids


def _matrix(batch_column: pa.Array) -> np.ndarray:
    values = batch_column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(batch_column), -1).astype(np.float64) if len(batch_column) else np.empty((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): rows with an id whose vector isn't null, empty, zero, and has neither null nor non-finite components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k nearest found of all other ids by largest inner product in double precision; ties go to smaller vec_id.

    Fewer candidates than k: all of them. Repeated vec_ids name one query and one candidate for
    each different vector. Vectors of another length have no inner product with a query and are no
    candidates of it: each length has an index of its own. No usable vectors: no rows.
    """
    rows = usable(vectors).withColumn("_length", F.size("embedding"))
    found = vectors.sparkSession.createDataFrame([], RESULT)
    lengths = [r._length for r in rows.select("_length").distinct().orderBy("_length").collect()]  # one, but for odd tables
    for n, length in enumerate(lengths):
        here = _of_one_length(rows.where(F.col("_length") == length).drop("_length"), k, every)
        found = found.union(here) if n else here
    if len(lengths) > 1:  # a repeated id may be a query in several
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return found


def _of_one_length(rows: DataFrame, k: int, every: int) -> DataFrame:
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    least = rows.distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)  # Spark cuts these before the shuffle, too
    entries = cut_lineage(least.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.element_at("ids", 1)))
    total = entries.count()
    spark = rows.sparkSession
    sample = entries.select("entry", "embedding").orderBy(F.xxhash64("entry"), "entry").limit(MAX_TRAIN).collect()  # bounded
    train = np.array([r.embedding for r in sample], np.float64)
    size = int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, total**0.5 / 16)))
    half = train.shape[1] // 2
    books = Codebooks(_fit(train[:, :half], size, 1), _fit(train[:, half:], size, 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = books.cells(_matrix(batch.column(0)))
                yield pa.record_batch([*batch.columns, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["embedding", "ids", "entry", "c1", "c2"])

    placed = cut_lineage(entries.mapInArrow(place, "embedding array<double>, ids array<long>, entry long, c1 int, c2 int"))
    counts = np.zeros((len(books.first), len(books.second)), np.int64)
    for r in placed.groupBy("c1", "c2").count().collect():  # as many as cells
        counts[r.c1, r.c2] = r["count"]
    enough = _enough(placed, books, counts, sample[:SAMPLE_QUERIES], total, k)

    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").distinct()

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_first: dict[int, list[int]] = {}
                for a, b in books.walk(np.array(vector), counts, enough):
                    by_first.setdefault(a, []).append(b)
                n = len(by_first)
                yield pa.record_batch([pa.array([query_id] * n, pa.int64()), pa.array([vector] * n, pa.list_(pa.float64())), pa.array(list(by_first), pa.int32()), pa.array(list(by_first.values()), pa.list_(pa.int32()))], names=["query_id", "embedding", "c1", "visited"])

    visits = cut_lineage(queries.mapInArrow(visit, "query_id long, embedding array<double>, c1 int, visited array<int>"))
    # a crowded first centroid is dealt out over groups of bounded size, both ways; as many rows as centroids
    asked = {r.c1: r["count"] for r in visits.groupBy("c1").count().collect()}
    sizes = [(c, -(-int(n) // GROUP) or 1, -(-asked.get(c, 0) // GROUP) or 1) for c, n in enumerate(counts.sum(1))]
    parts = F.broadcast(spark.createDataFrame(sizes, "c1 int, entry_parts int, query_parts int"))
    entry_part, query_part = F.pmod(F.xxhash64("entry"), F.col("entry_parts")).cast("int"), F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int")

    def all_of(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = visits.join(parts, "c1").withColumns({"q": query_part, "e": all_of("entry_parts")}).select("c1", "q", "e", "query_id", "embedding", "visited")
    right = placed.join(parts, "c1").withColumns({"e": entry_part, "q": all_of("query_parts")}).select("c1", "q", "e", "entry", "c2", "embedding", "ids")
    width = len(books.second)

    def rerank(asks: pd.DataFrame, holds: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(holds):
            return pd.DataFrame({"query_id": [], "entry": [], "score": [], "ids": []})
        holds = holds.sort_values(["c2", "entry"], ignore_index=True)
        matrix, entry = np.stack(holds["embedding"].to_numpy()), holds["entry"].to_numpy()
        cells, begins = np.unique(holds["c2"].to_numpy(), return_index=True)
        out = []
        for low in range(0, len(asks), 512):
            part = asks.iloc[low : low + 512]
            seen = np.zeros((len(part), width), bool)
            for i, visited in enumerate(part["visited"]):
                seen[i, visited] = True
            vectors = np.stack(part["embedding"].to_numpy())
            scores = np.full((len(part), len(entry)), -np.inf)
            for cell, a, b in zip(cells, begins, [*begins[1:], len(entry)]):  # only cells that the walk has passed
                i = np.flatnonzero(seen[:, cell])
                scores[i, a:b] = vectors[i] @ matrix[a:b].T
            for query_id, row in zip(part["query_id"].to_numpy(), scores):
                if len(row) > k + 1:
                    at = np.flatnonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1])
                else:
                    at = np.arange(len(row))
                at = at[row[at] > -np.inf]
                at = at[np.lexsort((entry[at], -row[at]))][: k + 1]
                out.append((np.full(len(at), query_id), at, row[at]))
        ids, at, score = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query_id": ids, "entry": entry[at], "score": score, "ids": holds["ids"].to_numpy()[at]})

    found = left.groupBy("c1", "q", "e").cogroup(right.groupBy("c1", "q", "e")).applyInPandas(rerank, "query_id long, entry long, score double, ids array<long>")
    by_entry = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "entry")
    best = found.withColumn("n", F.row_number().over(by_entry)).where(F.col("n") <= k + 1)
    each = best.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_id = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _enough(placed: DataFrame, books: Codebooks, counts: np.ndarray, sample: list, total: int, k: int) -> int:
    """Vectors that a walk must pass for RECALL of the sample queries' true neighbours."""
    probes = np.array([r.embedding for r in sample], np.float64)
    names = np.array([r.entry for r in sample])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = probes @ _matrix(batch.column(0)).T
            entry, a, b = (batch.column(i).to_numpy() for i in (1, 2, 3))
            scores[names[:, None] == entry[None, :]] = -np.inf
            top = np.argsort(-scores, 1, kind="stable")[:, :k]
            i = np.repeat(np.arange(len(probes)), top.shape[1])
            j = top.ravel()
            yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(scores[i, j]), pa.array(a[j]), pa.array(b[j])], names=["probe", "score", "c1", "c2"])

    found = placed.select("embedding", "entry", "c1", "c2").mapInArrow(nearest, "probe int, score double, c1 int, c2 int")
    order = Window.partitionBy("probe").orderBy(F.col("score").desc(), "c1", "c2")
    true = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("probe", "c1", "c2")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors in the cells that a walk passes up to each true neighbour's, that included."""
        half = books.first.shape[1]
        for batch in batches:
            probe, a, b = (batch.column(i).to_numpy() for i in range(3))
            held = np.zeros(len(probe), np.int64)
            for p in np.unique(probe):
                cost = -(books.first @ probes[p][:half])[:, None] - (books.second @ probes[p][half:])[None, :]
                in_order = np.argsort(cost, axis=None)
                upto = np.cumsum(counts.ravel()[in_order])
                mine = np.flatnonzero(probe == p)
                held[mine] = upto[np.searchsorted(cost.ravel()[in_order], cost[a[mine], b[mine]], side="right") - 1]
            yield pa.record_batch([pa.array(held)], names=["held"])

    needed = sorted(r.held for r in true.mapInArrow(passed, "held long").collect())  # SAMPLE_QUERIES * k numbers
    at = needed[min(len(needed) - 1, int(RECALL * len(needed)))] if needed else total
    return max(at, min(total, 50 * (k + 1)))

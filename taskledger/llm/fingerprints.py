"""Document fingerprints: SimHash over weighted terms, and search by permuted block tables.

Terms are pairs of neighbouring words (the word itself where there is but one), hashed to BITS
bits. A term votes for each bit that it has and against each that it lacks, with its weight: its
occurrences times the length of its words. The fingerprint has the bits with more votes for than against.

Tables: the bits are cut into blocks; fingerprints within radius r agree in at least blocks - r of
them, so that for one of the tables, each with another choice of blocks in front, the front is equal.
Fingerprints with equal fronts are compared inside a task, a stated set of queries with all, and a pair
counts in the first table that it meets in: no pair is a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, ids_and_texts, join_skewed, partitions

BITS, BYTES = 128, 16
SEED = 42
#: Differing bits within which fingerprints are near.
RADIUS = 6
#: Fingerprints for each value of a front, on average, up to which fronts of one block do; for more, fronts have two. Either finds the same.
PER_FRONT = 16
#: The registered search: fingerprints of rows whose doc_id is divisible by EVERY, against those of all rows.
EVERY = 100
#: Characters of a text by which rows of one doc_id are ordered before a hash.
PREFIX = 64
#: Queries, and fingerprints, of one front that meet in one group, about, where the front is crowded: has over this share of all rows.
GROUP, HOT_SHARE = 4_096, 10_000
#: One fingerprint in so many tells which fronts are crowded. This deals out work and changes no result.
SAMPLED = 16
#: A term's weight grows with its words' letters up to so many.
MAX_LETTERS = 16

_PLACE = np.arange(BYTES, dtype=np.int64) * 256
_SIGNS = (((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2 - 1).astype(np.float64)


def terms(text: str) -> tuple[list[bytes], np.ndarray]:
    """A text's terms, repeats included, with the weight of each occurrence."""
    found = text.lower().encode().split()
    if not found:
        return [], np.empty(0)
    if len(found) == 1:
        return found, np.ones(1)
    joined = b" ".join(found)
    sizes = list(map(len, found))
    ends = list(accumulate(sizes, lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    letters = np.array(sizes)
    return [joined[a:b] for a, b in zip(starts, ends[1:])], np.minimum(letters[:-1] + letters[1:], MAX_LETTERS).astype(np.float64)


def votes(text: str) -> np.ndarray:
    """Sum of signed votes for each bit."""
    found, weights = terms(text)
    total = np.zeros(BITS)
    for at in range(0, len(found), 1 << 15):
        hashed = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found[at : at + (1 << 15)], repeat(SEED))), np.uint8).reshape(-1, BYTES)
        w = np.repeat(weights[at : at + (1 << 15)], BYTES)
        total += (np.bincount((hashed + _PLACE).ravel(), w, BYTES * 256).reshape(BYTES, 256) @ _SIGNS).ravel()
    return total


def fingerprint(text: str) -> bytes:
    return np.packbits(votes(text) > 0, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - differing(a, b) / (8 * len(a))


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points (rounded down) replaced by the first as many, or all, of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp binary) of every row; null and empty texts have all bits zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.binary())], names=["doc_id", "fp"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, fp binary")


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc_id: int | None, text: str, own: bytes, following: str, theirs: bytes) -> tuple:
    changed = edited(text, following)
    new = fingerprint(changed) if changed != text else own
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), new.hex(), likeness(own, new), likeness(own, theirs)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within) of every row.

    The next document is that of the next doc_id, rising, rows of equal doc_id in an order by text; after the
    last row comes the first, and a null doc_id stands before all others. A single row follows
    itself. Rows are dealt out in ranges of doc_id, then text (its first PREFIX characters, then a hash), so that an id of very many rows is many ranges, and each task reads its range in order; where a
    range ends, its last text meets the first text of the next range in a second step that has
    two rows a range.

    n_within: for each doc_id divisible by EVERY, how many other rows have a fingerprint within
    RADIUS bits, found by the block tables; null for other rows.
    """
    rows = _edited(docs)
    queries = F.coalesce(F.col("doc_id") % EVERY == 0, F.lit(False))
    fps = rows.groupBy(F.unhex("fingerprint").alias("fp")).agg(F.count("*").alias("n"), F.count(F.when(queries, 1)).alias("asked"))
    counted = count_within(cut_lineage(fps))
    counted = cut_lineage(counted.select(F.lower(F.hex("fp")).alias("fingerprint"), (F.col("n_within") - 1).alias("n_within"), F.col("asked").alias("n")))
    asked = join_skewed(rows.where(queries), counted, "fingerprint", counted.agg(F.sum("n")).first()[0] or 0)
    return rows.where(~queries).withColumn("n_within", F.lit(None).cast("long")).unionByName(asked)


def _edited(docs: DataFrame) -> DataFrame:
    """The columns of edited_likeness() but n_within, kept in the checkpoint folder."""
    inner = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    ends = pa.schema([*inner, ("range", pa.int32()), ("edge", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        at = 0
        for whole in batches:
            for low in range(0, whole.num_rows, 128):
                rows = []
                batch = whole.slice(low, 128)
                for doc_id, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    text = text.as_py()
                    own = fingerprint(text)
                    if before is None:
                        rows.append((doc_id, None, None, None, None, None, None, at, "first", text))
                    else:
                        rows.append((*_compared(*before, text, own), at, None, None))
                    before = doc_id, text, own
                yield _batch(rows, ends)
        if before is not None:
            yield _batch([(before[0], *[None] * 6, at, "last", before[1])], ends)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = [_compared(row["doc_id"], row["text"], fingerprint(row["text"]), row["following"], fingerprint(row["following"]))]
                yield _batch(rows, inner)

    order = [F.col("doc_id").asc_nulls_first(), F.left("text", F.lit(PREFIX)), F.xxhash64("text"), F.col("copy")]
    rows = ids_and_texts(docs).withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(partitions(docs), *order).withColumn("range", F.spark_partition_id())
    found = rows.sortWithinPartitions(*order).select("doc_id", "text", "range").mapInArrow(run, f"{_RESULT}, range int, edge string, text string")
    found = cut_lineage(found)
    edges = found.where("edge is not null")
    firsts, lasts = edges.where("edge = 'first'"), edges.where("edge = 'last'")
    # ranges that have rows, numbered: two rows each
    order = Window.orderBy("range")
    firsts = firsts.select((F.row_number().over(order) - 1).alias("at"), F.col("text").alias("following"))
    lasts = lasts.select((F.row_number().over(order) % F.count("*").over(Window.partitionBy())).alias("at"), "doc_id", "text")
    met = lasts.join(firsts, "at").select("doc_id", "text", "following").mapInArrow(meet, _RESULT)
    return found.where("edge is null").select(*inner.names).union(cut_lineage(met))


class Tables:
    """Fronts of fingerprints: every choice of blocks - radius blocks is a table whose front they make, so that no pair within the radius is missed."""

    def __init__(self, radius: int, blocks: int) -> None:
        if not 0 <= radius < blocks:
            raise ValueError("the radius must be less than the number of blocks")
        cuts = [BITS * i // blocks for i in range(blocks + 1)]
        self.places = [np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in front]) for front in combinations(range(blocks), blocks - radius)]
        if max(map(len, self.places)) + len(self.places).bit_length() > 63:
            raise ValueError("fronts are too long: choose fewer blocks in front")

    def fronts(self, fps: np.ndarray) -> np.ndarray:
        """(fingerprints, tables): a number for the front of each fingerprint (rows of BYTES bytes) in each table; tables don't share numbers."""
        bits = np.unpackbits(fps, axis=1, bitorder="little").astype(np.int64)
        return np.stack([(bits[:, p] @ (1 << np.arange(len(p)))) * len(self.places) + n for n, p in enumerate(self.places)], 1)


def _bytes(fps) -> np.ndarray:
    return np.frombuffer(b"".join(fps), np.uint8).reshape(-1, BYTES)


def count_within(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(fp, asked, n_within) of each query: over all fingerprints within the radius, itself included, the sum of n.

    fps: (fp binary of BYTES bytes, n long, asked long), a row for each fingerprint; queries are those with
    asked > 0, and rows with a null fp are left out. Rows are sorted by front, queries first, and each task
    compares a front's queries with its fingerprints as they pass; a crowded front is dealt out to
    several tasks, both ways. blocks, if not given: such that fronts grow with the number of fingerprints.
    """
    fps = fps.select("fp", "n", "asked").where("fp is not null")
    total = fps.count()
    if blocks is None:
        blocks = radius + (1 if total <= PER_FRONT << BITS // (radius + 1) else 2)
    tables = Tables(radius, blocks)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fronts = tables.fronts(_bytes(batch.column(0).to_pylist()))
            every = pa.array(np.repeat(np.arange(batch.num_rows), fronts.shape[1]))
            yield pa.record_batch([pa.array(fronts.ravel()), *[c.take(every) for c in batch.columns]], names=["front", "fp", "n", "asked"])

    def with_fronts(some: DataFrame) -> DataFrame:
        return some.mapInArrow(emit, "front long, fp binary, n long, asked long")

    sample = with_fronts(fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0)).groupBy("front")
    sizes = sample.agg(F.count("*").alias("held"), F.count(F.when(F.col("asked") > 0, 1)).alias("asks"))
    bound = max(GROUP, total * len(tables.places) // HOT_SHARE)
    hot = sizes.where(F.col("held") * SAMPLED > bound)  # HOT_SHARE rows at most
    hot = F.broadcast(cut_lineage(hot.select("front", *[F.greatest(F.lit(1), F.ceil(F.col(c) * SAMPLED / GROUP)).cast("int").alias(k) for c, k in (("held", "e"), ("asks", "q"))])))
    rows = with_fronts(fps).join(hot, "front", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("e", "q")})

    def part(of: str) -> Column:
        return F.pmod(F.xxhash64("fp"), F.col(of)).cast("int").alias(of)

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias(of)

    asks = rows.where("asked > 0").select("front", "fp", part("q"), "e").select("front", "q", every("e"), F.lit(0).cast("long").alias("n"), "fp")
    holds = rows.select("front", "fp", "n", part("e"), "q").select("front", every("q"), "e", "n", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, fronts = None, np.empty((0, BYTES), np.uint8), None  # of the front that may go on
        for batch in batches:
            front, q, e, n = (batch.column(i).to_numpy() for i in range(4))
            fp = _bytes(batch.column(4).to_pylist())
            new = np.ones(len(front), bool)
            new[1:] = (front[1:] != front[:-1]) | (q[1:] != q[:-1]) | (e[1:] != e[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(front))
            queries = np.add.reduceat((n == 0).astype(np.int64), starts) if len(starts) else starts
            found, sums = [], []
            for at in np.flatnonzero((queries > 0) | (starts == 0)):
                low, high, many = starts[at], ends[at], queries[at]
                here = (front[low], q[low], e[low])
                if here != key:
                    asked = fp[:0]
                key, asked = here, np.concatenate([asked, fp[low : low + many]])
                theirs, weights = fp[low + many : high], n[low + many : high]
                table = int(here[0] % len(tables.places))
                fronts = tables.fronts(theirs)[:, :table] if len(asked) and len(theirs) else None
                for own in asked if fronts is not None else ():
                    near = np.flatnonzero(np.bitwise_count(theirs ^ own).sum(1) <= radius)
                    met = (fronts[near] == tables.fronts(own[None, :])[:, :table]).any(1)  # in an earlier table
                    if total := int(weights[near[~met]].sum()):
                        found.append(own.tobytes())
                        sums.append(total)
            if len(starts) and (front[-1], q[-1], e[-1]) != key:
                key, asked = None, fp[:0]
            if found:
                yield pa.record_batch([pa.array(found, pa.binary()), pa.array(sums, pa.int64())], names=["fp", "n_within"])

    both = asks.unionByName(holds).repartition(partitions(fps), "front", "q", "e").sortWithinPartitions("front", "q", "e", "n")
    sums = both.mapInArrow(compare, "fp binary, n_within long").groupBy("fp").agg(F.sum("n_within").alias("n_within"))
    return sums.join(fps.where("asked > 0").select("fp", "asked"), "fp")

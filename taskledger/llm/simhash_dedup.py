"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every fingerprint emits all its variants within half the radius; fingerprints that are near
share a variant. For an odd radius 2h+1, balls of radius h meet up to distance 2h only, so each
fingerprint is seen in three views that leave out one third of its bits: some view leaves out a bit
in which the two differ, and the rest differs in at most 2h.

Members of a variant differ by at most 2h in the view. So those with equal left-out thirds all hang
on one of them, and of each third one member is looked up under the third's one-bit flips. Only
differing bits that all lie in one third aren't met so: members with equal views are looked up under
all flips of their third. Links are verified on all 64 bits; they grow with the members, never with
their square, and a task sends on only a forest that spans them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, hex64, ids_and_texts, in_slices, join_skewed, partitions
from .components import connected_components

BITS = 64
SEED = 42
SHINGLE = 5
#: Rows of one variant that a task holds before it keeps one member of each third only, and links before it keeps a forest only. Both change no result.
HELD, LINKS = 1 << 18, 1 << 18
#: Members with equal views that are compared each with each; more are looked up by flips.
FEW = 64

_PLACE = np.arange(8, dtype=np.int64) * 256
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Unsigned XXH64 of every run of `words` words of the lower-cased text (A-Z only), repeats included."""
    found = text.encode().lower().split()  # of bytes: ASCII letters and white space only
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, found), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    runs = [joined[a:b] for a, b in zip(starts, ends[words - 1 :])]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bit is 1 where over half the hashes have it, as a signed long."""
    counts = np.zeros(BITS)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        at_byte = part.view(np.uint8).reshape(-1, 8) + _PLACE
        counts += (np.bincount(at_byte.ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE).ravel()
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, words: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, words))


def document_fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row of docs. An empty or null text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@dataclass(frozen=True)
class View:
    """Bits of a fingerprint that are seen; those left out hold the view's number in variants."""

    number: int
    low: int
    high: int

    @property
    def width(self) -> int:
        return self.high - self.low

    @property
    def left_out(self) -> int:
        return (1 << self.high) - (1 << self.low)

    @property
    def mark(self) -> int:
        return self.number << self.low if self.width else 0


def _views(radius: int) -> list[View]:
    """All bits for an even radius, all but a third for an odd one."""
    if radius % 2 == 0:
        return [View(0, BITS, BITS)]
    cuts = [0, 21, 42, BITS]
    return [View(n, a, b) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def _ball_variants(fps: DataFrame, radius: int) -> DataFrame:
    """(variant, fp): in each view, all variants within half the radius. The view's number stands in the bits that it leaves out, so views don't mix."""
    flips = []
    for view in _views(radius):
        bits = [i for i in range(BITS) if not view.low <= i < view.high]
        for weight in range(radius // 2 + 1):
            flips += [((1 << BITS) - 1 ^ view.left_out, sum(1 << i for i in c) | view.mark) for c in combinations(bits, weight)]
    each = F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.lit(_signed(f)).alias("flip")) for m, f in flips]))
    return fps.select("fp", each.alias("v")).select(F.col("fp").bitwiseAND(F.col("v.mask")).bitwiseXOR(F.col("v.flip")).alias("variant"), "fp")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of a negative number numpy counts the absolute value's bits


def _forest(links: np.ndarray) -> np.ndarray:
    """Of the links (rows of two), some that span the same components without a circle: Boruvka's rounds, in each of which every component takes its first link outward."""
    if not len(links):
        return links
    nodes, ends = np.unique(links, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    parent, taken = np.arange(len(nodes)), []
    at = np.arange(len(links))
    while True:
        at = at[parent[a[at]] != parent[b[at]]]
        if not len(at):
            return links[np.unique(np.concatenate([np.empty(0, np.int64), *taken]))]
        first = np.full(len(nodes), len(links))
        np.minimum.at(first, parent[a[at]], at)
        np.minimum.at(first, parent[b[at]], at)
        roots = np.flatnonzero(first < len(links))
        chosen = first[roots]
        taken.append(chosen)
        other = np.where(parent[a[chosen]] == roots, parent[b[chosen]], parent[a[chosen]])
        parent[roots] = other
        both = roots[(parent[other] == roots) & (roots < other)]  # two that took the same link: the smaller is the root
        parent[both] = both
        while (up := parent[parent]) is not None and not np.array_equal(up, parent):
            parent = up


class _Members:
    """Links among the members of whole variants: columns sorted by variant and fingerprint."""

    def __init__(self, radius: int) -> None:
        self.radius, self.half, self.views = radius, radius // 2, _views(radius)

    def links(self, variant: np.ndarray, fp: np.ndarray) -> np.ndarray:
        new = np.ones(len(variant), bool)
        new[1:] = variant[1:] != variant[:-1]
        run = np.cumsum(new) - 1
        many = (np.bincount(run, minlength=1) > 1)[run]
        variant, fp, run = variant[many], fp[many], run[many]
        found = [np.empty((0, 2), np.int64)]
        for view in self.views:
            far = (variant ^ fp).view(np.uint64) & np.uint64((1 << BITS) - 1 ^ view.left_out)
            distance = np.bitwise_count(far)
            here = np.flatnonzero((distance <= self.half) & (variant & _signed(view.left_out) == _signed(view.mark)))
            for a, b in self._of_view(view, run[here], fp[here], distance[here] == 0):
                near = _differing(a, b) <= self.radius
                found.append(np.stack([np.minimum(a, b)[near], np.maximum(a, b)[near]], 1))
        return np.concatenate(found)

    def _of_view(self, view: View, run: np.ndarray, fp: np.ndarray, exact: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key = run << view.width | (fp >> view.low if view.width else fp & 0) & ((1 << view.width) - 1)
        order = np.argsort(key, kind="stable")
        sorted_key, sorted_fp = key[order], fp[order]
        new = np.ones(len(key), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        keys, firsts = sorted_key[new], sorted_fp[new]
        hangs = np.flatnonzero(~new)
        yield firsts[np.cumsum(new) - 1][hangs], sorted_fp[hangs]
        yield from self._flipped(keys, firsts, [1 << i for i in range(view.width)])
        if self.radius == 3:  # equal views, three bits of the third; fewer are met in other views
            keys, fps, runs = key[exact], fp[exact], run[exact]
            of_run = np.bincount(runs, minlength=1)[runs]
            few = np.flatnonzero((of_run > 1) & (of_run <= FEW))
            for step in range(1, min(FEW, len(few))):
                i = few[step:][runs[few[step:]] == runs[few[:-step]]]
                if not len(i):
                    break
                yield fps[i], fps[i - step]
            crowd = np.flatnonzero(of_run > FEW)
            if len(crowd):
                in_order = crowd[np.argsort(keys[crowd])]
                yield from self._flipped(keys[in_order], fps[in_order], [sum(1 << i for i in c) for c in combinations(range(view.width), 3)])

    @staticmethod
    def _flipped(keys: np.ndarray, fps: np.ndarray, masks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose keys (sorted, no repeats) differ by a mask."""
        for mask in masks if len(keys) > 1 else ():
            other = keys ^ mask
            i = np.flatnonzero(other > keys)
            at = np.minimum(np.searchsorted(keys, other[i]), len(keys) - 1)
            hit = keys[at] == other[i]
            yield fps[i[hit]], fps[at[hit]]

    def kept(self, variant: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Of one variant's members, those that later ones must still meet: one of each third, and all with equal views; of either at most 2^22."""
        keep = np.zeros(len(fp), bool)
        for view in self.views:
            distance = np.bitwise_count((variant ^ fp).view(np.uint64) & np.uint64((1 << BITS) - 1 ^ view.left_out))
            keep |= distance == 0
            keep[np.unique((fp >> view.low if view.width else fp & 0) & ((1 << view.width) - 1), return_index=True)[1]] = True
        return keep


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) with a < b: links between distinct fingerprints (column fp long, no repeats needed) whose components are those of all pairs within the radius (0 to 3, or even).

    Every link is verified. A link may come more than once, at most once from each variant of a fingerprint.
    """
    if radius > 3 and radius % 2:
        raise ValueError("the radius must be 0 to 3, or even")
    parts = partitions(fps)
    fps = fps.select("fp").distinct().repartition(parts, F.xxhash64("fp"))  # few bytes, but many variants: not for the few tasks that Spark would take by size

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = _Members(radius)
        variant, fp = np.empty(0, np.int64), np.empty(0, np.int64)  # of the variant that may go on
        links, limit = np.empty((0, 2), np.int64), HELD  # sorted batches in, forests out

        def sent() -> pa.RecordBatch:
            return pa.record_batch([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            variant, fp = (np.concatenate([old, new.to_numpy(zero_copy_only=False)]) for old, new in zip((variant, fp), batch.columns))
            begin = int(np.searchsorted(variant, variant[-1]))
            links = np.concatenate([links, members.links(variant[:begin], fp[:begin])])
            variant, fp = variant[begin:], fp[begin:]
            if len(fp) > limit:
                links = np.concatenate([links, members.links(variant, fp)])
                keep = members.kept(variant, fp)
                variant, fp = variant[keep], fp[keep]
                limit = max(HELD, 2 * len(fp))
            if len(links) > LINKS:
                links = _forest(links)
                if len(links) > LINKS // 2:
                    yield sent()
                    links = links[:0]
        links = _forest(np.concatenate([links, members.links(variant, fp)]))
        if len(links):
            yield sent()

    return _ball_variants(fps, radius).repartition(parts, "variant").sortWithinPartitions("variant", "fp").mapInArrow(compare, "a long, b long")


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct (fp and what else, a row for each fingerprint) with `root`, the least fingerprint of the component: one row each on either side of the join."""
    parts = connected_components(near_links(distinct, radius)).withColumnsRenamed({"node": "fp", "component": "root"})
    return distinct.join(parts, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    fingerprint: 16 hexadecimal digits. Documents link where fingerprints differ in at most
    `radius` bits; component_id is the smallest doc_id reachable over links, itself included.
    Null and empty texts have fingerprint zero and link like any other. Rows that repeat, in
    doc_id or in whole, each give a row. A null doc_id never names a component unless no member
    has one. Extra columns are ignored; an empty table gives no rows.
    """
    marked = cut_lineage(document_fingerprints(docs, words))
    rooted = cut_lineage(_rooted(cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"))), radius))
    total = rooted.agg(F.count("*").alias("fps"), F.sum("n_rows").alias("rows")).first()
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    named = cut_lineage(join_skewed(rooted, least, "root", total.fps).select("fp", "component_id", F.col("n_rows").alias("n")))
    return join_skewed(marked, named, "fp", total.rows or 0).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3, words: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that of smallest doc_id, null last, and of rows that share it that of least text hash.

    A row is known by doc_id and text hash, so rows without an id, or that share one, stay apart where their texts aren't near.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), np.int64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "hash", "fp"])

    rows = ids_and_texts(docs).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("hash"), "text").mapInArrow(run, "doc_id long, hash binary, fp long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first")
    found = cut_lineage(rows.groupBy("fp").agg(first))  # of each fingerprint, the row that it would keep
    kept = _rooted(found, radius).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_kept"), F.col("first.hash").alias("_hash"))
    hashed = docs.withColumn("_text_hash", F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
    same = hashed["doc_id"].cast("long").eqNullSafe(kept["_kept"]) & (hashed["_text_hash"] == kept["_hash"])
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")

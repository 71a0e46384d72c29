"""Collocations: phrases whose words come together more often than apart, for each language.

Counts go up level by level, from words to phrases of two words, of three and so on. Candidates of a level are Apriori-safe:
a phrase is followed only if all of its words, and both of its parts that are one word shorter, may be frequent. The mappers over the texts
know that from a bitmap of hashes, of bounded size, in which nothing frequent is missing. A mapper's phrases are counted
once for each few megabytes of text before they leave it, so that no phrase is hot, and go to shards by hash.

A shard sums its phrases by hash classes first; those in classes under the threshold can't be frequent. The rest get slots by a
minimal perfect hash, whose stored keys tell whether a phrase is one of them. The shard's batches are counted by slot with
bincount, and the arrays are summed by a tree. The counts of a candidate's parts come from the levels below.

A word is known by 64 bits of a hash of its language and itself; should two words of the corpus share them, another seed is taken. So phrases are
known exactly, by the keys of their words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Words of the longest phrases, least count of a candidate, share (in %) of its count that drops it for a longer one, rows a language.
LONGEST, LEAST, COVERED, ROWS = 3, 10, 50, 2000
#: Bytes of text whose phrases are counted before they leave a mapper.
CHUNK_BYTES = 12_000_000
#: Phrases that a shard's task holds at a time, about.
SHARD_ROWS = 1 << 20
#: Tasks that phrases with one word in one place are dealt over.
SALTS = 8
#: Bits of the bitmap of frequent words or phrases: sixteen for each, in these bounds; beyond, more phrases are followed that turn out to be rare.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_BREAKS + b"\t" + bytes(range(65, 91)), b"\n" * len(_BREAKS) + b" " + bytes(range(97, 123)))
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(keys: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """64 bits of each key, given as arrays of its parts."""
    h = np.full(len(keys[0]), seed, np.uint64)
    for part in keys:
        h = (h ^ part.view(np.uint64)) * _MIX[0]
        h = (h ^ (h >> np.uint64(30))) * _MIX[1]
        h = (h ^ (h >> np.uint64(27))) * _MIX[2]
        h ^= h >> np.uint64(31)
    return h


class PerfectHash:
    """A minimal perfect hash over distinct keys, with the keys at their slots.

    Each level holds the keys that are alone at their place in a bit array of twice as many bits; the others go to the next. A key's slot is the rank of its bit.
    """

    def __init__(self, keys: list[np.ndarray]) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, start = keys, 0
        while len(rest[0]):
            size = 2 * len(rest[0])
            at = self._place(rest, size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, start + np.cumsum(alone) - alone))
            start += int(alone.sum())
            rest = [part[~alone[at]] for part in rest]
        self.stored = [np.zeros(start, np.int64) for _ in keys]
        slots = self._slots(keys)
        for held, part in zip(self.stored, keys):
            held[slots] = part

    def __len__(self) -> int:
        return len(self.stored[0])

    def _place(self, keys: list[np.ndarray], size: int, level: int | None = None) -> np.ndarray:
        return (mixed(keys, 1 + (len(self.levels) if level is None else level)) % np.uint64(max(1, size))).astype(np.int64)

    def _slots(self, keys: list[np.ndarray]) -> np.ndarray:
        slots, rest = np.full(len(keys[0]), -1), np.arange(len(keys[0]))
        for level, (alone, ranks) in enumerate(self.levels):
            at = self._place([part[rest] for part in keys], len(alone), level)
            hit = alone[at]
            slots[rest[hit]] = ranks[at[hit]]
            rest = rest[~hit]
        return slots

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """The slot of each key, -1 for those that are none of the hash's."""
        slots = self._slots(keys)
        if len(self):
            for held, part in zip(self.stored, keys):
                slots[held[slots] != part] = -1
        return slots


def tree_sum(arrays: Iterable[np.ndarray]) -> np.ndarray | None:
    """The sum of arrays, in pairs, then pairs of pairs: as many are held as the tree has levels."""
    held: list[tuple[int, np.ndarray]] = []
    for array in arrays:
        height = 0
        while held and held[-1][0] == height:
            array, height = array + held.pop()[1], height + 1
        held.append((height, array))
    while len(held) > 1:
        held[-2:] = [(held[-2][0], held[-2][1] + held[-1][1])]
    return held[0][1] if held else None


def count_frequent(batches: list[tuple[list[np.ndarray], np.ndarray]], least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(keys, counts) of those whose counts over all batches (keys, counts) are `least` or more."""
    size = 2 * sum(len(n) for _, n in batches) + 1
    classes = [(mixed(keys) % np.uint64(size)).astype(np.int64) for keys, _ in batches]
    sums = tree_sum(_added(at, n, size) for at, (_, n) in zip(classes, batches))
    safe = [np.column_stack([part[sums[at] >= least] for part in keys]) for at, (keys, _) in zip(classes, batches)]
    both = np.unique(np.concatenate(safe), axis=0)
    candidates = PerfectHash([np.ascontiguousarray(both[:, i]) for i in range(both.shape[1])])

    def by_slot(keys: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        slots = candidates.find(keys)
        return _added(slots[slots >= 0], n[slots >= 0], len(candidates))

    counts = tree_sum(by_slot(keys, n) for keys, n in batches)
    frequent = counts >= least
    return [part[frequent] for part in candidates.stored], counts[frequent]


def _added(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sums of n by place, in whole numbers: bincount adds in doubles, so that halves of n are added apart."""
    low = np.bincount(at, n & 0xFFFFFFFF, size).astype(np.int64)
    return low if not (n >> 32).any() else low + (np.bincount(at, n >> 32, size).astype(np.int64) << 32)


class Bitmap:
    """Which hashes may be frequent."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(len(self.bits) * 8 - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap_of(keys: DataFrame, count: int) -> Bitmap:
    """The bitmap of the keys' `h` (longs); as its size is bounded it passes through the driver and is broadcast."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count - 1).bit_length()))
    at = F.col("h").bitwiseAND(size - 1) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for row in rows.toLocalIterator():
        bits[(row.b - 1) * 4096 : row.b * 4096] = np.frombuffer(row.bits, np.uint8)
    return Bitmap(bits)


class Chunk:
    """A run of texts of one language: its distinct words, and its words' places among them in order; -1 is a break between pieces."""

    def __init__(self, text: bytes) -> None:
        found = pa.array(text.replace(b"\n", b" \n ").split(b" "), pa.binary()).dictionary_encode()
        words = found.dictionary.to_pylist()
        known = np.full(len(words), -2)
        kept = [i for i, w in enumerate(words) if w not in (b"", b"\n")]
        known[kept] = np.arange(len(kept))
        for i, w in enumerate(words):
            if w == b"\n":
                known[i] = -1
        at = known[found.indices.to_numpy()]
        self.words, self.at = [words[i] for i in kept], at[at != -2]

    def keys(self, lang: str, seed: int) -> np.ndarray:
        head = lang.encode() + b"\0"
        return np.fromiter((xxhash.xxh64_intdigest(head + w, seed) for w in self.words), np.uint64, len(self.words)).view(np.int64)

    def phrases(self, keys: np.ndarray, length: int, words: Bitmap, shorter: Bitmap | None) -> tuple[list[np.ndarray], np.ndarray]:
        """(keys by word, counts) of the chunk's distinct phrases of a length all of whose words, and both of whose parts one word shorter, may be frequent."""
        may = np.append(words(keys.view(np.uint64)), False)  # the last is for breaks
        n = len(self.at) - length + 1
        if n < 1:
            return [np.empty(0, np.int64)] * length, np.empty(0, np.int64)
        runs = [self.at[i : i + n] for i in range(length)]
        starts = np.flatnonzero(np.logical_and.reduce([may[run] for run in runs]))
        place = runs[0][starts]
        for i, run in enumerate(runs[1:], 1):  # numbers of distinct beginnings stay under the number of words
            if i > 1:
                place = np.unique(place, return_inverse=True)[1]
            place = place * len(self.words) + run[starts]
        _, first, counts = np.unique(place, return_index=True, return_counts=True)
        found = [keys[run[starts[first]]] for run in runs]
        if shorter:
            kept = shorter(mixed(found[:-1])) & shorter(mixed(found[1:]))
            found, counts = [part[kept] for part in found], counts[kept]
        return found, counts.astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[str, Chunk]]:
    """(lang, chunk) over (lang, text), about `size` bytes each; a piece is never cut."""
    held: dict[str, list[bytes]] = {}
    bytes_of: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
            while data:
                cut = len(data) if len(data) <= size else data.find(b"\n", size) + 1 or len(data)
                part, data = data[:cut], data[cut:]
                held.setdefault(lang, []).append(part)
                bytes_of[lang] = bytes_of.get(lang, 0) + len(part) + 1
                if sum(bytes_of.values()) >= size:
                    fullest = max(bytes_of, key=bytes_of.get)
                    yield fullest, Chunk(b"\n".join(held.pop(fullest)))
                    del bytes_of[fullest]
    for lang, parts in held.items():
        yield lang, Chunk(b"\n".join(parts))


class _Words:
    """All words (lang, word, key, f), under a seed that tells them all apart."""

    def __init__(self, texts: DataFrame, chunk: int, seeds: Iterable[int]) -> None:
        for self.seed in seeds:
            seed = self.seed

            def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for lang, part in chunks(batches, chunk):
                    n = np.bincount(part.at[part.at >= 0], minlength=len(part.words))
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n), pa.string()), "word": pa.array(part.words, pa.binary()).cast(pa.string()), "key": part.keys(lang, seed), "f": n.astype(np.int64)})

            found = texts.mapInArrow(count, "lang string, word string, key long, f long")
            self.all = written(found.groupBy("lang", "word", "key").agg(F.sum("f").alias("f")), "collocation-words")
            if not self.all.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").head(1):
                return
        raise ValueError("every seed has two words of one key")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, rows: int = ROWS, chunk: int = CHUNK_BYTES, shard: int = SHARD_ROWS, seeds: Iterable[int] = range(16)) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `rows` phrases by score, count and phrase.

    Letters A-Z are lower-cased; texts are cut into pieces at punctuation and line ends, and those into words at spaces and tabs. Of a candidate (2 to `longest` words, `least`
    times or more) the cut of least score counts. Candidates within a longer one that has `covered` % of their count are
    dropped. A null lang is `und`, a null text empty; rows that repeat count each time; no candidates: no rows. Counts up
    to 10^15 are exact.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    words = _Words(texts, chunk, seeds)
    total = words.all.groupBy("lang").agg(F.sum("f").alias("n"))
    sizes = words.all.agg(F.count_if(F.col("f") >= least).alias("frequent"), F.sum("f").alias("words")).first()
    frequent = words.all.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), F.col("key").alias("k1"), F.col("key").alias("h"), "f")
    levels, lists, shards = [frequent], [], 1 + (sizes.words or 0) // shard
    known = docs.sparkSession.sparkContext.broadcast(bitmap_of(frequent, sizes.frequent))
    shorter = None
    for length in range(2, longest + 1):
        counted = _level(texts, length, words.seed, known, shorter, least, chunk, shards)
        lists.append(_with_cuts(counted, levels, length))
        levels.append(lists[-1])
        if length < longest:
            shorter = docs.sparkSession.sparkContext.broadcast(bitmap_of(counted, counted.count()))
    kept = [_uncovered(a, b, i + 2, covered) for i, (a, b) in enumerate(zip(lists, lists[1:]))] + lists[-1:]
    every = kept[0].select("lang", "phrase", "f", "l", "r", "score")
    for more in kept[1:]:
        every = every.unionByName(more.select(*every.columns))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("f").desc(), "phrase")
    first = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= rows)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def _level(texts: DataFrame, length: int, seed: int, words, shorter, least: int, chunk: int, shards: int) -> DataFrame:
    """(k1 ... h, f) of the phrases of a length that come `least` times or more."""
    names = [f"k{i}" for i in range(1, length + 1)]
    longs = ", ".join(f"{k} long" for k in names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part in chunks(batches, chunk):
            keys, n = part.phrases(part.keys(lang, seed), length, words.value, shorter and shorter.value)
            of = (mixed(keys, 7) % np.uint64(shards)).astype(np.int32)
            for at in range(0, len(n), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in (of, *keys, n)], names=["shard", *names, "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by_shard(batches):
            keys, f = count_frequent(parts, least)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys, mixed(keys).view(np.int64), f)], names=[*names, "h", "f"])

    sent = texts.mapInArrow(send, f"shard int, {longs}, n long")
    dealt = sent.repartition(partitions(sent), "shard").sortWithinPartitions("shard")
    return written(dealt.mapInArrow(count, f"{longs}, h long, f long"), f"collocations-{length}")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(shard, its (keys, counts) by batch) of a partition that is in order of shards."""
    now, parts = None, []
    for batch in batches:
        of, *keys, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = [0, *np.flatnonzero(np.diff(of)) + 1, len(of)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if of[a] != now:
                    if parts:
                        yield now, parts
                    now, parts = of[a], []
                parts.append(([k[a:b].copy() for k in keys], n[a:b].copy()))
    if parts:
        yield now, parts


def _with_cuts(counted: DataFrame, levels: list[DataFrame], length: int) -> DataFrame:
    """Phrases (k1 ... f) with lang, phrase, and l, r and score of their least cut; levels: those of the lengths below."""
    names = [f"k{i}" for i in range(1, length + 1)]
    rows = counted.drop("h")
    for k in range(1, length):
        head, tail = levels[k - 1], levels[length - k - 1]
        words = ["lang", F.col("phrase").alias("_head")] if k == length - 1 else []
        rows = _look_up(rows, head, names[:k], [F.col("f").alias(f"_l{k}"), *words])
        rows = _look_up(rows, tail, names[k:], [F.col("f").alias(f"_r{k}"), *([F.col("phrase").alias("_tail")] if words else [])])

    def score(k: int):
        def whole(c: str):
            return f"cast({c} as decimal(38,0))"

        return F.expr(f"(1000000BD * {whole('f')} * {whole('f')}) div ({whole(f'_l{k}')} * {whole(f'_r{k}')})")

    least = F.array_min(F.array(*[F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")) for k in range(1, length)]))
    found = rows.withColumn("_cut", least).select("lang", F.concat_ws(" ", "_head", "_tail").alias("phrase"), *names, "f", "_cut.l", "_cut.r", "_cut.score")
    return written(found, f"collocation-cuts-{length}")


def _look_up(rows: DataFrame, level: DataFrame, keys: list[str], values: list) -> DataFrame:
    """rows with values of the phrase of a lower level that `keys` name. A word may be part of very many phrases, which are dealt over SALTS; longer parts are left to Spark's splitting."""
    own = level.select(*[F.col(f"k{i + 1}").alias(k) for i, k in enumerate(keys)], *values)
    if len(keys) > 1:
        return rows.join(own, keys)
    others = [c for c in rows.columns if c.startswith("k") and c not in keys]
    asks = rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int"))
    return asks.join(own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"]).drop("_salt")


def _uncovered(rows: DataFrame, longer: DataFrame, length: int, covered: int) -> DataFrame:
    """rows without those that stand in one a word longer that has `covered` % of their count; longer ones yet have no more."""
    names = [f"k{i}" for i in range(1, length + 2)]
    both = longer.select(F.explode(F.array(*[F.struct(*[F.col(k).alias(f"k{i + 1}") for i, k in enumerate(part)], F.col("f").alias("_f")) for part in (names[:-1], names[1:])])).alias("p")).select("p.*")
    most = both.groupBy(*names[:-1]).agg(F.max("_f").alias("_f"))
    return rows.join(most, names[:-1], "left").where(F.col("_f").isNull() | (F.col("_f") * 100 < F.col("f") * covered))

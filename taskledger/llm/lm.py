"""Language-model scores by cross-entropy difference.

A target and a background model, both of word pairs backed by words, share one vocabulary: the words
of all documents and an end of text. The target's counts come from documents labelled as good, the
background's from all documents, scaled to the target's size so that both are smoothed alike. A
document's score is the mean, over its words, of the background's loss less the target's: higher
is more like the target.

Words and pairs ("grams") are counted one by one over the whole corpus; their number grows with it. Documents are dealt to
chunks of bounded size. A chunk sends each of its grams once, with its counts, in sorted and packed lists,
one for each range of hashes; ranges add up what all chunks have sent and return the sums in each chunk's own order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crowded_ids, ids_and_texts, in_parts
from .toxicity import fold_of

#: Bytes of text in a chunk, and behind a range of hashes, about.
CHUNK_BYTES = 12_000_000
#: Count added to each word of the vocabulary, and weight of the words' distribution against a context's pairs.
ADDED, BACKING = 0.1, 2.0
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(xxhash.xxh3_64_intdigest(b" end of text ", 0))  # no word: it holds spaces


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words and of its pairs, from (first word, second) to (last word, end of text); letter case doesn't count.

    63 bits tell grams apart: words are even, pairs odd. No words: no pairs.
    """
    found = text.lower().encode().split()
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found, repeat(0)), np.uint64, len(found))
    after = np.append(words[1:], _END)[: len(words)]
    return (words & ~np.uint64(1)).view(np.int64), ((words * _MULTIPLIER + after) * _MULTIPLIER | np.uint64(1)).view(np.int64)


class Model:
    """Log-probabilities from counts, scaled: of words p(w) = (n(w) + ADDED) / (total + ADDED * vocabulary), of words after a word p(w|v) = (n(v, w) + BACKING * p(w)) / (n(v) + BACKING).

    Each sums to 1 over the vocabulary, the end of text included.
    """

    def __init__(self, total: float, vocabulary: int, scale: float = 1.0) -> None:
        self.total, self.vocabulary, self.scale = total * scale, vocabulary, scale

    def log_probs(self, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Of each word of a text, given the counts of its words and of the pairs that end with its second word and on."""
        words, pairs = self.scale * words, self.scale * pairs
        probs = (words + ADDED) / (self.total + ADDED * self.vocabulary)
        probs[1:] = (pairs + BACKING * probs[1:]) / (words[:-1] + BACKING)
        return np.log(probs)


class Chunk:
    """A chunk's texts as places in its sorted distinct grams, with their counts over all its texts and over those of the target."""

    def __init__(self, texts: pa.Table, good: np.ndarray) -> None:
        target = pc.is_in(texts["doc_id"], value_set=pa.array(good, pa.int64())).to_numpy()
        parts, self.n_words = [np.empty(0, np.int64)], np.zeros(texts.num_rows, np.int64)
        for i, text in enumerate(texts["text"]):
            words, pairs = grams(text.as_py())
            self.n_words[i] = len(words)
            parts += [words, pairs]
        end = (_END & ~np.uint64(1)).view(np.int64)
        parts.append(np.full(np.count_nonzero(self.n_words), end))
        flat = np.concatenate(parts)
        parts.clear()
        self.distinct, place = np.unique(flat, return_inverse=True)
        del flat
        self.place = place.astype(np.int32)
        del place
        self.starts = np.cumsum(2 * self.n_words) - 2 * self.n_words
        good_texts = np.repeat(target, 2 * self.n_words)
        ends = target[self.n_words > 0]
        self.n = np.bincount(self.place, minlength=len(self.distinct))
        self.good = np.bincount(self.place[np.concatenate([good_texts, ends])], minlength=len(self.distinct))

    def of_text(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of text i's words, and of its pairs but that with the end of text."""
        a, n = self.starts[i], self.n_words[i]
        return self.place[a : a + n], self.place[a + n : a + 2 * n - 1]

    def ranges(self, ranges: int) -> Iterator[tuple[int, slice]]:
        """(range, its grams) of each range of hashes that holds any."""
        bounds = np.searchsorted(self.distinct, _bounds(ranges))
        for at, (a, b) in enumerate(zip(bounds, [*bounds[1:], len(self.distinct)])):
            if b > a:
                yield at, slice(a, b)


def _bounds(ranges: int) -> np.ndarray:
    """Least gram of each range: signed longs in equal parts."""
    whole, rest = divmod(1 << 64, ranges)
    at = np.arange(ranges, dtype=np.uint64)
    return (at * np.uint64(whole & 0xFFFFFFFFFFFFFFFF) + at * np.uint64(rest) // np.uint64(ranges) ^ np.uint64(1 << 63)).view(np.int64)


def _pack(values: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Numbers of 64 bits, compressed byte place by byte place."""
    return press.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) of every row of docs; losses are nats a word.

    The target is every document labelled 1 outside fold 0 of the held-out split, labelled twice or
    not, every row of its id; the background is every row. Empty and null texts have no words, and losses and score of
    zero; so has everything if there is no target. Rows that repeat count each time; rows without
    an id are background only.
    """
    good = labels.where((F.col(label_col) == 1) & (fold_of(F.col("doc_id")) != 0)).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    texts = ids_and_texts(docs)
    crowded = crowded_ids(texts, CHUNK_BYTES)
    chunks = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES
    chunk = F.pmod(F.xxhash64("doc_id", "part"), F.lit(chunks)).alias("chunk")
    texts = in_parts(texts, crowded).select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "text", chunk)
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    good = good.join(crowded, "doc_id", "left").select("doc_id", every).select("doc_id", chunk).distinct()

    def send(texts: pa.Table, good: pa.Table) -> pa.Table:
        chunk, press, rows, least = Chunk(texts, good["doc_id"].to_numpy()), zstandard.ZstdCompressor(level=1), [], _bounds(chunks)
        for at, part in chunk.ranges(chunks):
            deltas = np.diff(chunk.distinct[part], prepend=least[at])
            rows.append((texts["chunk"][0].as_py(), at, _pack(deltas, press), _pack(chunk.n[part], press), _pack(chunk.good[part], press)))
        columns = zip(*rows) if rows else [()] * 5
        return pa.table({k: pa.array(c, t) for (k, t), c in zip((("chunk", pa.int64()), ("range", pa.int64()), ("grams", pa.binary()), ("n", pa.binary()), ("good", pa.binary())), columns)})

    def add_up(sent: pa.Table) -> pa.Table:
        press, first = zstandard.ZstdCompressor(level=1), _bounds(chunks)[sent["range"][0].as_py()]
        lists = [first + np.cumsum(_unpack(x)) for x in sent["grams"].to_pylist()]
        distinct, place = np.unique(np.concatenate(lists), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([_unpack(x) for x in sent[c].to_pylist()]).astype(np.float64), len(distinct)).astype(np.int64) for c in ("n", "good")]
        ends = np.cumsum([0, *map(len, lists)])
        back = [[_pack(s[place[a:b]], press) for a, b in zip(ends, ends[1:])] for s in sums]
        word = distinct & 1 == 0
        words = [int(word.sum()), int(sums[0][word].sum()), int(sums[1][word].sum())]
        rows = [*sent["chunk"].to_pylist(), -1], [*sent["range"].to_pylist(), -1], [*back[0], None], [*back[1], None], [*[None] * len(lists), words]
        return pa.table({k: pa.array(r, t) for (k, t), r in zip((("chunk", pa.int64()), ("range", pa.int64()), ("n", pa.binary()), ("good", pa.binary()), ("words", pa.list_(pa.int64()))), rows)})

    def score(texts: pa.Table, got: pa.Table) -> pa.Table:
        of_range = got["range"].to_pylist()
        ids = [r["doc_id"] for r in got.select(["range", "doc_id"]).to_pylist() if r["range"] == -2]
        chunk = Chunk(texts, np.array(ids, np.int64))
        losses = np.zeros((2, texts.num_rows))
        row_of = {r: i for i, r in enumerate(of_range)}
        whole = [r for r in (got["whole"][i].as_py() for i, r in enumerate(of_range) if r == -1)]
        vocabulary, total, total_good = whole[0] if whole else (0, 0, 0)
        if texts.num_rows and total_good:
            for at, part in chunk.ranges(chunks):
                chunk.n[part], chunk.good[part] = _unpack(got["n"][row_of[at]].as_py()), _unpack(got["good"][row_of[at]].as_py())
            models = (Model(total_good, vocabulary), chunk.good), (Model(total, vocabulary, total_good / total), chunk.n)
            for i in np.flatnonzero(chunk.n_words):
                words, pairs = chunk.of_text(i)
                losses[:, i] = [-model.log_probs(n[words], n[pairs]).mean() for model, n in models]
        return pa.table({"doc_id": texts["doc_id"], "n_words": chunk.n_words, "target_loss": losses[0], "background_loss": losses[1], "score": losses[1] - losses[0]})

    sent = texts.groupBy("chunk").cogroup(good.groupBy("chunk")).applyInArrow(send, "chunk long, range long, grams binary, n binary, good binary")
    summed = sent.groupBy("range").applyInArrow(add_up, "chunk long, range long, n binary, good binary, words array<long>")
    # one job, in which Spark shuffles the texts, and what the chunks send, once for both uses
    whole = summed.where("chunk = -1").agg(F.array(*[F.coalesce(F.sum(F.col("words")[i]), F.lit(0)) for i in range(3)]).alias("whole"))
    no_sums, no_id, no_words = [F.lit(None).cast("binary").alias(c) for c in ("n", "good")], F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("array<long>").alias("whole")
    to_all = docs.sparkSession.range(chunks).select(F.col("id").alias("chunk"), F.lit(-1).cast("long").alias("range"), *no_sums, no_id).crossJoin(F.broadcast(whole))  # one row
    ids = good.select("chunk", F.lit(-2).cast("long").alias("range"), *no_sums, "doc_id", no_words)
    back = summed.where("chunk >= 0").select("chunk", "range", "n", "good", no_id, no_words).union(ids).union(to_all)
    return texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, "doc_id long, n_words long, target_loss double, background_loss double, score double")

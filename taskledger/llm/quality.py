"""Quality by a byte-level convolutional network in numpy.

A text is read as symbols: a symbol is a byte, and whether it ends four bytes that stood within the REACH bytes
before, too (a filter can't compare bytes; repetition is what it would miss). Overlapping chunks cover the whole text. Learned
filters run over each chunk and are max-pooled; the mean and the maximum over a text's chunks go into one probability.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts
from .toxicity import fold_of

#: Labelled rows that the network is fitted on, at most: those of least hash; and chunks of each, evenly over its text. Scores have no bounds.
MAX_TRAIN, TRAIN_CHUNKS = 6_000, 8
#: Bytes of a chunk, and from one to the next.
CHUNK, STEP = 512, 448
#: Bytes before a symbol in which it looks for its last GRAM bytes.
REACH, GRAM = 24, 4
SYMBOLS, DIMENSIONS, WIDTH, STRIDE, FILTERS = 512, 8, 8, 2, 32
#: Fitting: steps of Adam, texts a step, rate, decay of weights.
STEPS, TEXTS, RATE, DECAY = 500, 48, 4e-3, 1e-4
#: Chunks that are in memory at a time.
AT_ONCE = 256


def symbols(data: bytes) -> np.ndarray:
    """Symbols of a text: bytes, plus 256 where the last GRAM bytes repeat within REACH. As unsigned shorts."""
    found = np.frombuffer(data, np.uint8)
    out = found.astype(np.uint16)
    if len(found) <= GRAM:
        return out
    grams = np.zeros(len(found) - GRAM + 1, np.uint32)
    for i in range(GRAM):
        grams |= found[i : len(grams) + i].astype(np.uint32) << np.uint32(8 * i)
    again = np.zeros(len(grams), bool)
    for back in range(1, min(REACH, len(grams) - 1) + 1):
        again[back:] |= grams[back:] == grams[:-back]
    out[GRAM - 1 :] += again.astype(np.uint16) << np.uint16(8)
    return out


def cut(found: np.ndarray) -> np.ndarray:
    """Overlapping chunks of a text's symbols, a row each, the last filled up with zeros: a row also for an empty text."""
    n = 1 + max(0, -(-(len(found) - CHUNK) // STEP))
    filled = np.zeros((n - 1) * STEP + CHUNK, np.uint16)
    filled[: len(found)] = found
    return np.lib.stride_tricks.sliding_window_view(filled, CHUNK)[::STEP]


@dataclass
class Network:
    """embedding (symbols x dimensions), filters (width x dimensions, filters), bias, and the weights of 2 x filters pooled values and their bias."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    base: np.ndarray

    @classmethod
    def new(cls, seed: int = 0) -> Network:
        draw = np.random.default_rng(seed)
        made = [draw.normal(0, 0.5, (SYMBOLS, DIMENSIONS)), draw.normal(0, 0.3, (WIDTH * DIMENSIONS, FILTERS)), np.zeros(FILTERS), draw.normal(0, 0.1, 2 * FILTERS), np.zeros(1)]
        return cls(*(x.astype(np.float32) for x in made))

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """(chunks, places, width x dimensions): what the filters see."""
        seen = self.embedding[rows].reshape(len(rows), -1)
        return np.lib.stride_tricks.sliding_window_view(seen, WIDTH * DIMENSIONS, axis=1)[:, :: STRIDE * DIMENSIONS]

    def respond(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, places, filters) of responses, and the windows."""
        seen = np.ascontiguousarray(self.windows(rows))
        return (seen.reshape(-1, seen.shape[2]) @ self.filters).reshape(*seen.shape[:2], -1), seen

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """(chunks, filters): each filter's strongest response in each chunk, not below zero."""
        parts = [np.maximum(self.respond(rows[i : i + AT_ONCE])[0].max(1) + self.bias, 0) for i in range(0, len(rows), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros((0, FILTERS), np.float32)

    def combine(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probabilities of texts whose chunks begin at `starts`."""
        n = np.diff(np.append(starts, len(pooled)))
        both = np.concatenate([np.add.reduceat(pooled, starts) / n[:, None], np.maximum.reduceat(pooled, starts)], axis=1)
        return 1 / (1 + np.exp(-np.clip(both @ self.weights + self.base, -30, 30).astype(np.float64)))

    def gradient(self, rows: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean log-loss, by each of the network's arrays."""
        seen_at = (np.arange(CHUNK)[None, :WIDTH] + STRIDE * np.arange((CHUNK - WIDTH) // STRIDE + 1)[:, None]).astype(np.int64)
        responses, seen = self.respond(rows)
        at = responses.argmax(1)
        best = np.take_along_axis(responses, at[:, None], 1)[:, 0] + self.bias
        pooled = np.maximum(best, 0)
        n = np.diff(np.append(starts, len(rows)))
        mean, most = np.add.reduceat(pooled, starts) / n[:, None], np.maximum.reduceat(pooled, starts)
        error = ((self.combine(pooled, starts) - labels) / len(labels)).astype(np.float32)
        both = np.concatenate([mean, most], axis=1)
        of_text = np.repeat(np.arange(len(starts)), n)
        first = pooled == most[of_text]
        first &= np.concatenate([np.cumsum(first[a : a + k], axis=0) == 1 for a, k in zip(starts, n)])  # of equals the first
        to_pooled = error[of_text, None] * (self.weights[:FILTERS] / n[of_text, None] + self.weights[FILTERS:] * first) * (best > 0)
        looked = np.take_along_axis(seen, at[:, :, None], 1)  # chunks, filters, width x dimensions
        to_filters = np.einsum("cf,cfw->wf", to_pooled, looked)
        to_seen = (to_pooled[:, :, None] * self.filters.T[None]).reshape(-1, DIMENSIONS)
        which = np.take_along_axis(rows[:, None, :], seen_at[at].reshape(len(rows), 1, -1), 2).reshape(-1)
        to_embedding = np.stack([np.bincount(which, to_seen[:, d], SYMBOLS) for d in range(DIMENSIONS)], axis=1)
        return [to_embedding.astype(np.float32), to_filters, to_pooled.sum(0), both.T @ error, error.sum(keepdims=True)]


def fit(texts: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 0) -> Network:
    """The network after some steps of Adam; texts are rows of chunks."""
    net, draw = Network.new(seed), np.random.default_rng(seed)
    arrays = [net.embedding, net.filters, net.bias, net.weights, net.base]
    means, squares = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    net.base[:] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    order = np.empty(0, np.int64)
    for t in range(1, steps + 1):
        while len(order) < min(TEXTS, len(texts)):
            order = np.append(order, draw.permutation(len(texts)))
        some, order = order[:TEXTS], order[TEXTS:]
        starts = np.cumsum([0, *(len(texts[i]) for i in some[:-1])])
        rate = RATE * (1 - t / (steps + 1))
        for a, g, m, s in zip(arrays, net.gradient(np.concatenate([texts[i] for i in some]), starts, labels[some]), means, squares):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            a -= rate * (m / (1 - 0.9**t) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8) + DECAY * a)
    return net


def learn_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, held_out: int = 1) -> Network | float:
    """The network fitted in one task on labelled rows outside the held-out fold, MAX_TRAIN at most, TRAIN_CHUNKS chunks of each; equal texts count once.

    A doc_id labelled twice with different labels counts as 0. Without labels of both kinds there is nothing to fit: the one label's number, or a half, is every score.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.min("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut(symbols(t.encode())) for t in batch.column(0).to_pylist()]
            some = [r[np.unique(np.linspace(0, len(r) - 1, TRAIN_CHUNKS).astype(int))] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in some], pa.binary()), batch.column(1)], names=["chunks", "label"])

    # at most MAX_TRAIN rows of two numbers are broadcast, and as many of TRAIN_CHUNKS chunks meet in one task
    rows = ids_and_texts(docs).join(F.broadcast(ids), "doc_id").select("text", "label").mapInArrow(sample, "chunks binary, label int")
    rows = rows.groupBy("chunks").agg(F.min("label").alias("label")).repartition(1).sortWithinPartitions(F.xxhash64("chunks"), "chunks")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [(np.frombuffer(c, np.uint16).reshape(-1, CHUNK), y) for batch in batches for c, y in zip(*(x.to_pylist() for x in batch.columns))]
        if not both:
            return
        known = np.array([y for _, y in both], float)
        net = fit([c for c, _ in both], known) if 0 < known.sum() < len(known) else float(known.mean())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["network"])

    found = rows.mapInArrow(train, "network binary").first()
    return pickle.loads(found.network) if found else 0.5


def score_quality(docs: DataFrame, network: Network | float) -> DataFrame:
    """(doc_id, score) of every row: of the whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            scores = np.full(len(ids), network) if isinstance(network, float) else _scores(network, (t.as_py().encode() for t in texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, score double")


def _scores(network: Network, texts: Iterator[bytes]) -> np.ndarray:
    """Scores of texts; chunks of several texts run together, those of a long one in parts."""
    scores: list[np.ndarray] = [np.empty(0)]
    rows: list[np.ndarray] = []

    def run() -> None:
        if rows:
            scores.append(network.combine(network.pooled(np.concatenate(rows)), np.cumsum([0, *map(len, rows[:-1])])))
            rows.clear()

    for text in texts:
        rows.append(cut(symbols(text)))
        if sum(map(len, rows)) >= AT_ONCE:
            run()
    run()
    return np.concatenate(scores)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; labels, language and source are no inputs of the score."""
    scored = score_quality(docs, learn_quality(docs, labels))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

import math
import random
import zlib
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from taskledger.llm import lm as L
from taskledger.llm.toxicity import fold_of

from .conftest import ODD, WORDS


def corpus():
    draw = random.Random(10)
    rows = [(i, " ".join(draw.choices(WORDS[:8] if i % 3 == 0 else WORDS[8:], k=100))) for i in range(150)]
    return rows, [(i, int(i % 3 == 0)) for i in range(150)]


def test_difference_tells_the_target_apart_on_held_out(spark, docs):
    rows, labels = corpus()
    got = {r.doc_id: r for r in L.cross_entropy_difference(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert min(got[i].score for i in held if i % 3 == 0) > max(got[i].score for i in held if i % 3)
    assert all(math.isclose(r.score, r.background_loss - r.target_loss) for r in got.values())


def test_each_model_sums_to_one():
    """Over the vocabulary and the end of text, after any word and by itself, whatever the scale."""
    texts = ["a b a c", "b a", "c"]
    counted, pairs = Counter(), Counter()
    for t in texts:
        found = t.split()
        counted.update([*found, "end"])
        pairs.update(zip(found, [*found[1:], "end"]))
    for scale in (1.0, 0.1):
        model = L.Model(sum(counted.values()), len(counted), scale)
        words = np.array([counted[w] for w in counted])
        assert math.isclose(sum(math.exp(model.log_probs(np.array([n]), np.empty(0))[0]) for n in words), 1)
        for v in "abc":
            after = [math.exp(model.log_probs(np.array([counted[v], counted[w]]), np.array([pairs[v, w]]))[1]) for w in counted]
            assert math.isclose(sum(after), 1)


def test_packed_lists_come_back():
    draw = np.random.default_rng(1)
    for values in (np.empty(0, np.int64), np.array([-1, 1 << 62]), draw.integers(-(1 << 63), (1 << 63) - 1, 1_000)):
        assert (L._unpack(L._pack(values, zstandard.ZstdCompressor())) == values).all()


def test_odd_rows_and_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = L.cross_entropy_difference(docs(ODD), none).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.0}
    assert L.cross_entropy_difference(docs([]), none).count() == 0


def test_target_is_every_labelled_document(spark):
    rows = spark.range(70_000).where(fold_of(F.col("id")) != 0).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id") % 97).alias("text"))
    got = L.cross_entropy_difference(rows, rows.select("doc_id", F.lit(1).alias("quality")))
    assert got.where("score <> 0 or n_words <> 2").count() == 0 < got.count() - 50_000  # both models count the same documents


def test_scores_are_those_of_brute_force(spark, docs, monkeypatch):
    """Several chunks and ranges, repeated rows, ids labelled twice, no ids, and a very long text."""
    monkeypatch.setattr(L, "CHUNK_BYTES", 2_000)
    rows, labels = corpus()
    rows = [*rows, rows[0], (None, "alpha beta"), (None, "alpha beta"), (1000, "Unseen alpha"), (1001, "mu " * 20_000), (1002, None)]
    labels = [*labels, labels[0], (3, 0), (None, 1), (4_000, 1)]
    good = {i for i, q in labels if i is not None and q and zlib.crc32(str(i).encode()) % 5}
    counts = [(Counter(), Counter()), (Counter(), Counter())]
    for i, t in rows:
        found = (t or "").lower().split()
        for words, pairs in counts if i in good else counts[:1]:
            words.update([*found, "end of text"] if found else [])
            pairs.update(zip(found, [*found[1:], "end of text"]))
    totals = [sum(words.values()) for words, _ in counts]

    def loss(found, model):
        (words, pairs), scale = counts[model], totals[1] / totals[model]
        if not found:
            return 0.0
        alone = [(scale * words[w] + L.ADDED) / (scale * totals[model] + L.ADDED * len(counts[0][0])) for w in found]
        probs = alone[:1] + [(scale * pairs[p] + L.BACKING * a) / (scale * words[p[0]] + L.BACKING) for p, a in zip(zip(found, found[1:]), alone[1:])]
        return -sum(map(math.log, probs)) / len(found)

    want = sorted((i or -1, len((t or "").split()), *(round(loss((t or "").lower().split(), k), 9) for k in (1, 0))) for i, t in rows)
    got = L.cross_entropy_difference(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert sorted((r.doc_id or -1, r.n_words, round(r.target_loss, 9), round(r.background_loss, 9)) for r in got) == want
    assert all(math.isclose(r.score, r.background_loss - r.target_loss, abs_tol=1e-12) for r in got)

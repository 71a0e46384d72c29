import math
import zlib

import numpy as np
import pytest

from taskledger.llm.quality import AT_ONCE, CHUNK, FILTERS, GRAM, REACH, STEP, STRIDE, WIDTH, Network, _scores, cut, fit, learn_quality, quality, score_quality, symbols
from taskledger.llm.queries import QUERIES

from .conftest import ODD

SCHEMA = "doc_id long, quality int, toxic int, score string"


def plain_symbols(data):
    out = []
    for i in range(len(data)):
        last = data[i - GRAM + 1 : i + 1] if i >= GRAM - 1 else None
        out.append(data[i] + 256 * any(last == data[i - b - GRAM + 1 : i - b + 1] for b in range(1, REACH + 1) if last and i - b >= GRAM - 1))
    return out


def plain_score(net, data):
    """The definition, one number at a time."""
    found = plain_symbols(data)
    pooled = []
    at = 0
    while not pooled or at < len(found) and at + CHUNK - STEP < len(found):
        row = (found[at : at + CHUNK] + [0] * CHUNK)[:CHUNK]
        seen = np.concatenate([net.embedding[s] for s in row]).astype(float)
        d = net.embedding.shape[1]
        pooled.append([max(0.0, max(float(seen[p * d : (p + WIDTH) * d] @ net.filters[:, f]) for p in range(0, CHUNK - WIDTH + 1, STRIDE)) + float(net.bias[f])) for f in range(FILTERS)])
        at += STEP
    both = np.append(np.mean(pooled, 0), np.max(pooled, 0))
    return 1 / (1 + math.exp(-float(both @ net.weights.astype(float) + net.base[0])))


@pytest.mark.parametrize("text", ["", "a", "abcabcabc the the the", "é日本 " * 90, "word word " * 120, "x" * 512, "y" * 513, "z" * 961])
def test_scores_equal_the_definition(text):
    net = Network.new(3)
    assert symbols(text.encode()).tolist() == plain_symbols(text.encode())
    assert abs(_scores(net, iter([text.encode()]))[0] - plain_score(net, text.encode())) < 1e-4


def test_texts_don_t_mix():
    net, texts = Network.new(1), [b"a b c", b"", b"long text. " * 5000, b"d", b"x y" * 200] * 3
    apart = [_scores(net, iter([t]))[0] for t in texts]
    assert np.allclose(_scores(net, iter(texts)), apart, atol=1e-5)
    assert len(cut(symbols(texts[2]))) < AT_ONCE < sum(len(cut(symbols(t))) for t in texts)


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        found = np.arange(n, dtype=np.uint16) % 500 + 1
        rows = cut(found)
        assert set(found) <= set(rows.ravel()) and rows[-1].any() == (n > 0)
        assert all((rows[i, STEP:] == rows[i + 1, : CHUNK - STEP]).all() for i in range(len(rows) - 1))
    clean, net = b"Some words of plain text. " * 800, Network.new(2)
    net.weights[:FILTERS], net.weights[FILTERS:] = 0, 0.01
    assert _scores(net, iter([clean]))[0] != _scores(net, iter([clean + b"### $$$ %%% &&&" * 9]))[0]


def test_gradient_by_differences():
    net = Network.new(5)
    for name in vars(net):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rows = np.concatenate([cut(symbols(t)) for t in (b"ab the the cd" * 70, b"Q", b"### x" * 9)])
    starts, labels = np.array([0, len(rows) - 2, len(rows) - 1]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.combine(net.pooled(rows), starts)
        return -float(np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))

    draw = np.random.default_rng(0)
    for array, gradient in zip(vars(net).values(), net.gradient(rows, starts, labels)):
        places = np.flatnonzero(np.abs(gradient.ravel()) > 1e-6)
        for i in draw.permutation(places)[:12]:
            kept, step = array.ravel()[i], 1e-6
            array.ravel()[i] = kept + step
            above = loss()
            array.ravel()[i] = kept - step
            below = loss()
            array.ravel()[i] = kept
            assert abs((above - below) / (2 * step) - gradient.ravel()[i]) < 1e-4 + 0.02 * abs(gradient.ravel()[i])


def test_fit_learns_repetition():
    draw = np.random.default_rng(1)
    words = ["".join(draw.choice(list("abcdefgh"), draw.integers(3, 7))) for _ in range(400)]

    def text(bad):
        some = draw.choice(words, 60)
        return " ".join(np.repeat(some, 2) if bad else some).encode()

    labels = np.array([i % 2 for i in range(200)], float)
    net = fit([cut(symbols(text(not y))) for y in labels[:140]], labels[:140], steps=120)
    again = fit([cut(symbols(text(not y))) for y in labels[:2]], labels[:2], steps=2)
    assert again is not net
    scores = _scores(net, (text(not y) for y in labels[140:]))
    assert ((scores >= 0.5) == labels[140:]).mean() > 0.95


def test_odd_rows_and_labels(spark, docs):
    rows = docs(ODD)
    for known in ([], [(5, 1, 0, "x")], [(3, 1, 0, "x"), (None, 0, 0, "x")]):
        labels = spark.createDataFrame(known, SCHEMA)
        found = quality(rows, labels)
        assert found.columns == ["doc_id", "held_out", "score", "predicted"]
        got = found.collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in got)
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(1, 9)], SCHEMA)
    net = learn_quality(rows, labels)
    assert len({round(r.score, 6) for r in score_quality(rows, net).where("doc_id = 5 or doc_id = 1").collect()}) == 2
    assert quality(docs([]), labels).collect() == []


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    scored = QUERIES["op12_quality"](spark, folder).where("held_out")
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("quality", "predicted").collect()
    right = [r.quality == r.predicted for r in rows]
    assert len(right) > 100 and sum(right) / len(right) > 0.95

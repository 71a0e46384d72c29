"""Ids that very many rows share, and rows without an id: results as for any other ids, in time that grows with the rows."""

import random
import time

import numpy as np
import public_tokenizers
import pytest

from taskledger.llm import bpe, fingerprints, lm, substring, toxicity
from taskledger.llm.common import LEAST_ID, crowded_ids, ids_and_texts, in_parts

from .conftest import WORDS


def texts(n, seed=0, words=40):
    draw = random.Random(seed)
    some = [" ".join(draw.choice(WORDS) + str(draw.randrange(400)) for _ in range(7)) + "." for _ in range(n // 4)]
    return [" ".join(draw.choice(some) for _ in range(words // 7)) for _ in range(n)]


def bound_of(monkeypatch, module, bound):
    monkeypatch.setattr(module, "crowded_ids", lambda t, *_: crowded_ids(t, bound))


def sorted_rows(df):
    return sorted(map(repr, df.collect()))


def test_parts(spark, docs):
    rows = docs([(7, t) for t in texts(60)] + [(None, t) for t in texts(60, 1)] + [(i, "a few words") for i in range(20, 40)] + [(8, "x" * 5000)])
    known = ids_and_texts(rows)
    crowded = crowded_ids(known, 2000)
    assert {r.doc_id for r in crowded.collect()} == {7, LEAST_ID}  # one long text alone isn't crowded
    got = in_parts(known, crowded).collect()
    assert len(got) == 141 and {r.part for r in got if r.doc_id not in (7, LEAST_ID)} == {0}
    assert len({r.part for r in got if r.doc_id == 7}) > 3 and all(r.none == (r.doc_id == LEAST_ID) for r in got)


def test_bpe_rows_of_one_id(spark, docs, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    some = texts(200)
    rows = docs([(7, t) for t in some] + [(None, t) for t in some] + [(1, some[0]), (7, None)])
    apart = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip_digests(docs(list(enumerate(some))), path).collect()}
    for bound in (500, 1 << 40):
        bound_of(monkeypatch, bpe, bound)
        got = sorted_rows(bpe.round_trip_digests(rows, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
        want = [(7, *apart[i]) for i in range(200)] + [(None, *apart[i]) for i in range(200)] + [(1, *apart[0])]
        assert len(got) == 402 and sum(f"doc_id={d}," in r and x in r for r in got for d, n, x, _ in want[:5]) >= 5
        assert sorted(r.split("n_tokens=")[1] for r in got if "n_tokens=0" not in r) == sorted(f"{n}, ids_sha256='{a}', decoded_sha256='{b}')" for _, n, a, b in want)


def test_substring_parts_change_nothing(spark, docs, monkeypatch):
    some = texts(240)
    rows = docs([(i % 3 if i % 5 else None, t) for i, t in enumerate(some)] + [(9, t) for t in some[::3]])
    results = []
    for bound in (300, 1 << 40):
        bound_of(monkeypatch, substring, bound)
        results.append(sorted_rows(substring.remove_repeats(rows)))
    assert results[0] == results[1] and any("n_removed=0" not in r for r in results[0])


def test_lm_parts_change_nothing(spark, docs, monkeypatch):
    some = texts(200)
    rows = docs([(i % 4, t) for i, t in enumerate(some)] + [(None, t) for t in some[:40]])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    results = []
    for bound in (400, 1 << 40):
        bound_of(monkeypatch, lm, bound)
        monkeypatch.setattr(lm, "CHUNK_BYTES", 8000)
        found = lm.cross_entropy_difference(rows, labels).collect()
        results.append(sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, round(r.target_loss, 9), round(r.score, 9)) for r in found))
    assert results[0] == results[1] and len({r[3] for r in results[0]}) > 100


def test_fingerprints_of_one_id(spark, docs):
    rows = docs([(7, t) for t in texts(300)] + [(None, "same text") for _ in range(200)] + [(8, "end")])
    got = fingerprints.edited_likeness(rows).collect()
    assert len(got) == 501
    same = [r for r in got if r.doc_id is None]
    assert sum(r.near_next == 1.0 for r in same) == 199


@pytest.mark.parametrize("run", ["bpe", "substring", "lm", "fingerprints"])
def test_time_grows_with_the_rows(spark, docs, run):
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    operators = {
        "bpe": lambda d: bpe.round_trip_digests(d, public_tokenizers.path("word_bpe_49k.json")),
        "substring": substring.remove_repeats,
        "lm": lambda d: lm.cross_entropy_difference(d, labels),
        "fingerprints": fingerprints.edited_likeness,
    }
    took = []
    for n in (6_000, 12_000):
        rows = docs([(7 if i % 2 else None, t) for i, t in enumerate(texts(n))]).persist()
        rows.count()
        began = time.time()
        operators[run](rows).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 3


def test_ranges_are_found_once():
    began = time.time()
    assert lm._bounds(25_000).tolist()[::5_000] == [-(1 << 63) + (1 << 64) * i // 25_000 for i in range(0, 25_000, 5_000)]
    assert [lm._bounds(n).tolist() for n in (1, 3)] == [[-(1 << 63)], [-(1 << 63) + (1 << 64) * i // 3 for i in range(3)]]
    import pyarrow as pa

    chunk = lm.Chunk(pa.table({"doc_id": pa.array(range(2000)), "text": texts(2000)}), np.array([1, 2]))
    assert sum(part.stop - part.start for _, part in chunk.ranges(2_500)) == len(chunk.distinct)
    assert time.time() - began < 10


def test_exception_phrases_by_one_sweep():
    matcher = toxicity.Lexicon({"clown": 1.0, "fish*": 2.0}, ["clown fish", "fish clown", "big clown fish"]).matcher()
    began = time.time()
    assert matcher.hits("clown fish " * 100_000) == [] and time.time() - began < 10
    draw = random.Random(4)
    for _ in range(200):
        spans = sorted({(a, a + draw.randrange(1, 9)) for a in (draw.randrange(60) for _ in range(8))}, key=lambda s: s[1])
        found = sorted(((a, a + draw.randrange(1, 5), 1.0) for a in (draw.randrange(60) for _ in range(12))), key=lambda h: h[1])
        assert toxicity._outside(found, spans) == [h for h in found if not any(a <= h[0] and h[1] <= b for a, b in spans)]

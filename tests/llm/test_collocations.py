import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from taskledger.llm.collocations import Chunk, PerfectHash, chunks, collocations, count_frequent, mixed, tree_sum
from taskledger.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SF
from .conftest import ODD

FIELDS = "lang rank phrase a l r n score".split()


def brute(rows, longest=3, least=10, covered=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(m == lang and len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), b in found.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, mine in out.items() for i, (score, a, p, left, right) in enumerate(sorted(mine)[:top])}


def frame(spark, rows):
    full = [(i, text, lang, "k", 1, 2, "z") for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, phrase string, k1 int, n int, word string").repartition(4)


def texts(seed, n=300):
    draw = random.Random(seed)
    words = ["New", "york", "city", "hall", "the", "ÉTÉ", "été", "a", "of", "São", "Paulo", "x y", "\U0001f600", "kick", "bucket"]
    marks = [" ", " ", "  ", "\t", ". ", ", ", "\n", "; ", " \x0b", "\r\n", "!", "?", ":"]
    phrases = ["New York city ", "kick the bucket ", "são paulo"]
    return [(draw.choice(["en", "de", None, "und"]), "".join(draw.choice(phrases) if draw.random() < 0.2 else draw.choice(words) + draw.choice(marks) for _ in range(draw.randrange(40)))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"chunk": 200, "shard": 50}, {"longest": 4, "least": 3, "rows": 7}, {"longest": 2, "covered": 10, "chunk": 1}])
def test_equals_brute_force(spark, options):
    rows = texts(1) + [(lang, text) for _, text in ODD for lang in ("en", None)] + [("fr", "a b " * 30_000)]
    found = collocations(frame(spark, rows), **options)
    assert found.columns == FIELDS
    want = brute(rows, **{{"rows": "top"}.get(k, k): v for k, v in options.items() if k not in ("chunk", "shard")})
    assert {tuple(r) for r in found.collect()} == want and want


def test_another_seed_after_a_collision(spark, monkeypatch):
    rows, whole = texts(2), Chunk.keys

    def keys(self, lang, seed):
        return whole(self, lang, seed) & (0x1F if seed == 0 else -1)

    import taskledger.llm.collocations as module
    from pyspark import cloudpickle

    monkeypatch.setattr(Chunk, "keys", keys)
    cloudpickle.register_pickle_by_value(module)
    try:
        found = collocations(frame(spark, rows))
        assert {tuple(r) for r in found.collect()} == brute(rows)
        with pytest.raises(ValueError):
            collocations(frame(spark, rows), seeds=[0])
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def test_empty_tables(spark):
    assert collocations(frame(spark, [])).collect() == []
    assert collocations(frame(spark, [(None, None), ("en", "")])).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    draw = np.random.default_rng(n)
    keys = [draw.integers(-50, 50, 2 * n) if i else draw.integers(-(2**62), 2**62, 2 * n) for i in range(2)]
    inside, outside = [k[:n] for k in keys], [k[n:] for k in keys]
    found = PerfectHash(inside)
    assert sorted(found.find(inside)) == list(range(n))
    assert (found.find(outside) == -1).all()


def test_counts_are_whole_numbers():
    assert tree_sum(iter([])) is None
    assert [int(tree_sum(np.array([i]) for i in range(n))[0]) for n in (1, 2, 5, 8, 100)] == [n * (n - 1) // 2 for n in (1, 2, 5, 8, 100)]
    key = np.array([5, 6])
    batches = [([key, key], np.array([2**53 + 1, 1])), ([key, key], np.array([2**40, 8]))]
    keys, n = count_frequent(batches, 10)
    assert [k.tolist() for k in keys] == [[5], [5]] and n.tolist() == [2**53 + 1 + 2**40]
    assert len(set(mixed([np.arange(1000), np.zeros(1000, np.int64)]))) == 1000


def test_chunks_keep_pieces_whole():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en", "de"], "text": ["a b c d. e f", "g\th", "i"]})
    parts = [(lang, c.words, c.at.tolist()) for lang, c in chunks(iter([batch]), 3)]
    assert [(lang, [b"\n" if i < 0 else w[i] for i in at]) for lang, w, at in parts][0] == ("en", [b"a", b"b", b"c", b"d", b"\n"])
    assert sum(len(w) for _, w, _ in parts) == 9


def test_query_equals_sql_and_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    found = {tuple(r) for r in QUERIES["op13_collocations"](spark, SF).collect()}
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = db.sql(ORACLE_SQL["op13_collocations"]).select(*FIELDS).fetchall()
    assert found == set(want) and len(want) == len(found)
    assert sorted(found)[:50] == sorted(brute(rows))[:50]

import numpy as np

from taskledger.llm import ann as A


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            scored = sorted({(-round(float(v @ w), 9), i) for i, w in ok if i != q})
            out[q] = [(i, -s) for s, i in scored][:k]
    return out


def vectors(n=3_000):
    draw = np.random.default_rng(0)
    centres = draw.normal(size=(12, 8))
    return [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.4 * draw.normal(size=8)]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, c1 int, entry int").repartition(3)


def test_recall_scores_and_ranks(spark):
    rows = vectors()
    vector = dict(rows)
    want = brute(rows)
    got = {}
    for r in A.neighbours(table(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {i for _, i, _ in found}
        assert all(abs(s - np.dot(vector[q], vector[i])) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    rows = vectors(60)
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [0.0] * 6), (2060, [float("nan")] * 8), (2080, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (2100, [])]
    got = {}
    for r in A.neighbours(table(spark, rows)).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    want = brute(rows)
    assert {q: [f[k] for k in sorted(f)] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}


def test_each_length_is_searched_by_itself(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=4 if i % 3 else 6).tolist()) for i in range(0, 60, 5)] + [(40, draw.normal(size=6).tolist())]
    want = {}
    for q, v in rows:
        if q % 20 == 0:
            for i, w in rows:
                if i != q and len(v) == len(w):
                    want.setdefault(q, {}).setdefault(i, []).append(float(np.dot(v, w)))
    got = {}
    for r in A.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    for q, found in want.items():
        best = sorted((-round(max(s), 9), i) for i, s in found.items())
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]


def test_recall_of_queries_that_the_walk_was_not_set_on(spark, monkeypatch):
    """Vectors without clusters, few sample queries: all other queries are held out."""
    monkeypatch.setattr(A, "SAMPLE_QUERIES", 40)
    draw = np.random.default_rng(9)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(4_000)]
    want = {q: {i for i, _ in f} for q, f in brute(rows).items()}
    got = {}
    for r in A.neighbours(table(spark, rows)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & w) for q, w in want.items()) / (20 * len(want)) >= 0.9


def test_few_rows_and_none(spark):
    assert A.neighbours(table(spark, [])).count() == 0
    got = A.neighbours(table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])])).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5)]


def test_walk_is_in_order_of_distance():
    draw = np.random.default_rng(1)
    books = A.Codebooks(draw.normal(size=(6, 3)), draw.normal(size=(5, 3)))
    counts = draw.integers(0, 3, size=(6, 5))
    query = draw.normal(size=6)
    cost = lambda c: -(books.first[c[0]] @ query[:3] + books.second[c[1]] @ query[3:])
    cells = books.walk(query, counts, 10**9)
    assert sorted(cells) == [tuple(c) for c in np.argwhere(counts > 0)]
    assert [cost(c) for c in cells] == sorted(cost(c) for c in cells)

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from taskledger.llm import simhash_dedup as S
from taskledger.llm.common import join_salted, join_skewed
from taskledger.llm.components import connected_components

from .conftest import ODD, WORDS


def brute_fingerprint(text, words):
    found = [w for w in "".join(c.lower() if c.isascii() else c for c in text).encode().split()]
    runs = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    counts = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(runs))


def brute_components(values, radius):
    """Root of each distinct value under links of at most `radius` bits."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", ["", "a", "A b", "a b c", "The QUICK brown fox É ß", "a b c d e f g " * 9])
def test_fingerprint(text):
    for words in (3, 5):
        assert S.fingerprint(text, words) & (1 << 64) - 1 == brute_fingerprint(text, words)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_have_the_components_of_all_pairs(spark, radius):
    draw = random.Random(radius)
    values = [draw.getrandbits(64) for _ in range(40)]
    for v in values[:20]:  # chains of flips, some within the radius and some not
        for _ in range(4):
            v ^= sum(1 << b for b in draw.sample(range(64), draw.choice([1, 2, 3, 4])))
            values.append(v)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    links = [(r.a, r.b) for r in S.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in links)
    brute = brute_components(signed, radius)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()} if links else {}
    assert {v: got.get(v, v) for v in brute} == brute


def dense(seed=5):
    """Many fingerprints around one: two flips anywhere, three in a row, and a code in the lowest third whose words differ in three bits or more."""
    draw = random.Random(seed)
    centre = draw.getrandbits(63)
    values = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(0, 62, 3) for b in range(1, 62, 4)} | {centre ^ 0b111 << i for i in range(0, 60, 2)}
    other = draw.getrandbits(63) & ~0xFFFF
    hamming = [v for v in range(1 << 13) if not sum((k + 1) * (v >> k & 1) for k in range(13)) % 16 and v.bit_count() % 2]
    return values | {other ^ v << 1 for v in hamming}


@pytest.mark.parametrize("held", [None, 8])
def test_crowded_neighbourhood(spark, monkeypatch, held):
    """Links and exploded rows grow with the members, and no component is lost, also where a task keeps few rows and links."""
    values = dense()
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    assert S._ball_variants(fps, 3).count() == len(values) * (3 + 43 + 43 + 42)
    if held:
        near = S._ball_variants(fps, 3).orderBy("variant", "fp").toPandas()
        variant, fp = near["variant"].to_numpy(), near["fp"].to_numpy()
        members, old, links = S._Members(3), (np.empty(0, np.int64),) * 2, []
        for at in range(0, len(variant), held):  # as a task does that holds next to nothing
            v, f = (np.concatenate([a, b[at : at + held]]) for a, b in zip(old, (variant, fp)))
            links += members.links(v, f).tolist()
            begin = int(np.searchsorted(v, v[-1]))
            keep = members.kept(v[begin:], f[begin:])
            old = v[begin:][keep], f[begin:][keep]
        links = S._forest(np.array(links)).tolist()
    else:
        links = [(r.a, r.b) for r in S.near_links(fps, 3).collect()]
        assert len(links) < 3 * len(values)  # a forest from each of three tasks
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {v: got.get(v, v) for v in values} == brute_components(values, 3)


def test_forest_spans_and_has_no_circle():
    draw = random.Random(1)
    for n, m in ((2, 1), (10, 40), (200, 150), (300, 3_000)):
        links = np.array([draw.sample(range(n), 2) for _ in range(m)])
        forest = S._forest(links).tolist()
        sets = {v: {v} for v in range(n)}
        for a, b in forest:
            assert [a, b] in links.tolist() and sets[a] is not sets[b]
            sets[a] |= sets[b]
            for v in sets[b]:
                sets[v] = sets[a]
        assert all(sets[a] is sets[b] for a, b in links.tolist())


def test_hot_keys_and_odd_radius(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3_000)], "k long, v long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").withColumn("w", F.col("k") * 2)
    want = left.join(right.drop("n"), "k")
    got = join_skewed(left, right, "k", 3_000)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    right = right.withColumn("k2", F.lit(1))
    want = left.withColumn("k2", F.lit(1)).join(right.drop("n"), ["k", "k2"])
    got = join_salted(left.withColumn("k2", F.lit(1)), right.drop("n"), ["k", "k2"], right.select("k", "k2", "n"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="radius"):
        S.near_links(spark.createDataFrame([(1,)], "fp long"), 5)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 301), (301, 300), (300, 301)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 5)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_and_clashing_columns(docs):
    near = " ".join(WORDS * 40)
    rows = [*ODD, (20, near), (21, near.replace("omega", "Omega")), (22, near + " end")]
    got = S.near_duplicates(docs(rows), 3, 3).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].fingerprint == "0" * 16 == by_id[2].fingerprint == by_id[6].fingerprint
    assert {by_id[i].component_id for i in (1, 2, 6)} == {1}
    assert by_id[20].component_id == by_id[21].component_id == 20
    values = {i: brute_fingerprint(t or "", 3) for i, t in rows}
    roots = brute_components(values.values(), 3)
    for i, r in by_id.items():
        assert r.component_id == min(j for j, v in values.items() if j is not None and roots[v] == roots[values[i]])


def test_keep_one(docs):
    text = " ".join(WORDS * 3)
    kept = S.keep_one(docs([(1, text), (2, text), (3, "another text"), (3, "another text"), (4, None)]), 3, 3)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert kept.columns == docs([]).columns


def test_empty_table(docs):
    assert S.near_duplicates(docs([]), 3, 3).count() == 0


def test_keep_one_of_rows_without_or_with_shared_ids(docs):
    a, b, c, d = (" ".join(random.Random(k).choices(WORDS, k=60)) for k in range(4))
    got = [(r.doc_id, r.text) for r in S.keep_one(docs([(None, a), (None, a), (None, b), (7, c), (7, d), (8, d), (9, b)]), 3, 3).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (9, b), (7, c), (7, d)], key=str)

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskledger.llm import mixing as M
from taskledger.llm.queries import ORACLE_SQL

from .conftest import ODD


def brute_targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    weight = {n: M.WEIGHTS[i % 3] for i, n in enumerate(names)}
    left, target = 1.5 * sum(sizes.values()), {}
    open_ = set(names)
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if level * weight[n] > 2 * sizes[n]}
        if not full:
            return target | {n: level * weight[n] for n in open_}
        for n in full:
            target[n] = 2.0 * sizes[n]
            left -= target[n]
        open_ -= full
    return target


def corpus():
    rows = [(i, "w " * (i % 11) + "end") for i in range(400)]
    return [*rows, *ODD, (400, "big " * 3_000)]


def test_targets_and_taken(docs):
    table = docs(corpus())
    got = M.mix(table).collect()
    source = {(r.doc_id, r.text): r.source for r in table.collect()}
    sizes = {}
    for r in table.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(corpus())
    by_size = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(min(want.values(), key=lambda t: abs(t - r.target)))
        by_size.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert sum(t for t, _ in by_size.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for target, taken in by_size.values():
        assert abs(taken - target) <= 2
    again = M.mix(table.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert source


def test_empty_and_wordless_tables(docs):
    assert M.mix(docs([])).count() == 0
    assert {(r.size, r.taken, r.target) for r in M.mix(docs([(1, None), (2, " ")])).collect()} == {(0, 0, 0.0)}


def test_split_tree_has_exact_quotas():
    blocks = np.array([10, 0, 1, 4096, 33])
    room = M.even(int(blocks.sum()), 16)
    out = M.split_tree(blocks, room, np.random.default_rng(1))
    assert (out.sum(1) == blocks).all() and out.min() >= 0 and (out.sum(0) == room).all() and room.max() - room.min() <= 1
    assert (out == M.split_tree(blocks, room, np.random.default_rng(1))).all()


def test_leaves_of_many_sources(spark):
    """More sources than groups: rows sum to the quotas, columns are even, and the spread is that of drawing without replacement."""
    quotas = {r: 20 + r % 7 for r in range(1, 601)}
    plans = spark.createDataFrame(list(quotas.items()), "rank long, quota long")
    ends = {r.rank: r.ends for r in M._leaves(plans, 8, 3).collect()}
    table = np.array([np.diff([0, *ends[r]]) for r in quotas])
    assert (table.sum(1) == list(quotas.values())).all()
    assert (table.sum(0) == M.even(sum(quotas.values()), 8)).all()
    n = np.array(list(quotas.values()))
    assert 0.7 < (((table - n[:, None] / 8) ** 2).sum() / (n * 7 / 8).sum()) < 1.3


def test_place_and_sums_before(spark):
    rows = [(f"s{i:03}", i % 5) for i in range(100)] + [(None, 7)]
    got = sorted(map(tuple, M._in_order(spark.createDataFrame(rows, "source string, n long"), [F.col("source").asc_nulls_last()], ("n",)).collect()), key=lambda r: r[2])
    before = np.cumsum([0, *(n for _, n in rows)])
    assert [(r[0], r[2], r[3]) for r in got] == [(s, i, before[i]) for i, (s, _) in enumerate(rows)]


@pytest.mark.parametrize("limit", [None, 0])
def test_what_the_shards_draw_is_what_the_mix_takes(docs, monkeypatch, limit):
    """taken by brute force: each source's blocks in order, pass after pass, are dealt to the shards by the leaves; also where plans are joined, not broadcast."""
    if limit is not None:
        monkeypatch.setattr(M, "BROADCAST_BYTES", limit)
    table = docs(corpus())
    plans = {r.source: r for r in M.source_plans(table, 5).collect()}
    keys = {}
    for r in table.select("*", M.permutation_key().alias("key")).collect():
        keys.setdefault(r.source, []).append((r.key, r.doc_id, len((r.text or "").split())))
    want = []
    for source, rows in keys.items():
        plan = plans[source]
        drawn = {}
        for shard, (a, b) in enumerate(zip([0, *plan.ends], plan.ends)):
            for at in range(a, b):
                drawn.setdefault(at % M.BLOCKS, []).append((at, shard))
        for key, doc_id, size in rows:
            taken = 0
            for at, _ in drawn.get(int(key[: M.BLOCK_DIGITS], 16), []):
                last = plan.cut_block is not None and at == plan.cut_block
                taken += size if not last or key < plan.cut else plan.part if key == plan.cut else 0
            want.append((doc_id, size, taken))
    assert sorted(((r.doc_id, r.size, r.taken) for r in M.mix(table, 5).collect()), key=str) == sorted(want, key=str)


def test_mixed_documents_hold_what_the_mix_takes(docs):
    """All rows, null and repeated ids too; a text that is cut is a prefix of its document's, and shards are laid out whole."""
    table = docs(corpus())
    taken, words, shards = {}, {}, set()
    texts = {(r.doc_id, r.source): set() for r in table.collect()}
    for r in table.collect():
        texts[r.doc_id, r.source].add(r.text)
    for r in M.mix(table).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    mixed = M.mixed_documents(table)
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
        shards.add(r._shard)
        assert any(t and t.startswith(r.text) for t in texts[r.doc_id, r.source]) and r.n_chars == len(r.text)
    assert words == {i: n for i, n in taken.items() if n}
    assert shards <= set(range(M.LEAST_SHARDS)) and len(shards) > M.LEAST_SHARDS / 2
    laid = M.in_shards(mixed).select("_shard", "_place", F.spark_partition_id().alias("task")).collect()
    assert len({(r._shard, r.task) for r in laid}) == len(shards)
    for task in {r.task for r in laid}:
        mine = [(r._shard, r._place) for r in laid if r.task == task]
        assert mine == sorted(mine)


def test_sql_is_registered():
    assert "op7_mixing" in ORACLE_SQL


def test_a_shard_may_be_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_SHARDS", 1)  # so that the session's 3 partitions are 3 runs of each shard
    rows = spark.range(3000).selectExpr("id", "cast(id % 4 as int) as _shard", "xxhash64(id) as _place").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = M.in_shards(rows).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.id for r in laid) == list(range(3000)) and len({r.task for r in laid}) > 1
    runs = {}
    for r in laid:
        runs.setdefault((r._shard, min(2, int((r._place / 2**64 + 0.5) * 3))), []).append((r.task, r._place))
    assert len(runs) == 12
    for run in runs.values():  # each run is in one task, in order
        assert len({t for t, _ in run}) == 1 and [p for _, p in run] == sorted(p for _, p in run)

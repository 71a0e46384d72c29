"""Rounds of connected components over few edges run in few tasks."""

from taskledger.llm.components import connected_components


def test_few_edges_are_not_dealt_out_over_all_partitions(spark):
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in zip(names, ("false", "16")):
            spark.conf.set(name, value)
        found = connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long"))
        assert found.rdd.getNumPartitions() == 1 + 16  # edges to roots, and the roots among the nodes
        assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)

"""Every ledger query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from taskledger.queries import ORACLE_SQL, QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


def plain(value):
    if pd.isna(value):
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr([plain(v) for v in row]) for row in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["claim_list"](spark, SF))
    assert "TakeOrderedAndProject" in plan(QUERIES["purge"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderkey)" in plan(QUERIES["get"](spark, SF)) or "Exchange" not in plan(QUERIES["get"](spark, SF))
    assert plan(QUERIES["stats"](spark, SF)).count("Exchange hash") == 1
    for name in QUERIES:
        assert "CartesianProduct" not in plan(QUERIES[name](spark, SF)), name


@pytest.mark.parametrize("name", ["submit", "submit_replace", "submit_reuse", "submit_reuse_succeeded", "submit_reject"])
def test_submissions_are_dealt_out_once(spark, name):
    """By key, to meet their keys' tasks; nothing is kept in the checkpoint folder."""
    submitted = plan(QUERIES[name](spark, SF))
    assert "Scan ExistingRDD" not in submitted
    assert submitted.count("Exchange hashpartitioning(key#") <= 2 + 2 * (name == "submit")
    assert "SortMergeJoin [id#" not in submitted.split("Union")[0]

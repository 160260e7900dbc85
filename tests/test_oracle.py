"""Every query with checking SQL gives the same rows in both engines."""

import pytest

from check import compare, connect
from lapforge.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_same_rows_without_blind_products(spark, con, name):
    plans = []

    def run(session, folder):
        df = QUERIES[name](session, folder)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    _, problem = compare(spark, con, run, ORACLES[name], FOLDER)
    assert problem is None, problem
    assert "CartesianProduct" not in plans[0] and "BroadcastNestedLoopJoin" not in plans[0]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    assert entry(spark).count() > 0
    assert queries().keys() >= oracle_sql().keys()


@pytest.mark.parametrize("name", ["match_candidates", "preprocess", "boosted_trees_scores"])
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0

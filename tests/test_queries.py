"""The registered queries against their SQL, on the smallest tables.

``tests/oracle_check.py`` runs the same comparison on larger ones.
"""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from packetloom.plans.oracles import ORACLES
from packetloom.plans.queries import REGISTRY

# Eight and two fits at full size, some minutes; test_models.py runs the same job at small sizes.
HEAVY = {"model_metrics", "flow_model_metrics"}
# What SQL cannot state: vectors, and models whose results no rule gives.
NO_SQL = {"onehot", "rf_predict", "kmeans_sweep", "iforest_nodes", "anomaly_scores"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.queries()) and set(ORACLES) <= set(REGISTRY)
    assert set(REGISTRY) - set(ORACLES) == HEAVY | NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, small, name):
    # Some views are empty on tables this small.
    assert compare(REGISTRY[name](spark, small), con, ORACLES[name]) in (None, "no rows")


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(ORACLES) - HEAVY))
def test_query_runs(spark, small, name):
    assert REGISTRY[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

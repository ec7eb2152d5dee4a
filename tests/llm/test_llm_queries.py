import pytest
from oracle_check import compare, connect

from packetloom.llm.queries import ORACLES, QUERIES


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, medium, name):
    assert compare(QUERIES[name](spark, medium), connect(medium), ORACLES[name]) is None

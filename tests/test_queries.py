"""Every named query against its SQL."""

import pytest

import __spark_entry__
from tests.compare import connect, differences
from tests.conftest import SMALL

QUERIES = __spark_entry__.queries()
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SMALL), duck, SQL[name]) == []


def test_every_query_has_sql():
    own = {name for name in QUERIES if not name.startswith("op") and name != "pipeline"}
    assert own - set(SQL) == set()


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns[:3] == ["person_id", "observation_period_id", "concept_ids"]
    assert frame.count() > 200

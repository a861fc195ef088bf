"""Every relational and streaming query against its SQL twin."""

import pytest

import duck
from sparkloom.plans import registry


@pytest.fixture(scope="module")
def con():
    return duck.connection()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_agrees_with_its_sql(spark, con, name):
    duck.agree(registry.QUERIES[name](spark, duck.SMALL), registry.ORACLE[name], con)

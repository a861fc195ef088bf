"""The opN_ queries that SQL can express, over whole tables."""

import pytest

import duck
from sparkloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_its_sql(spark, name):
    duck.agree(QUERIES[name](spark, duck.SMALL), ORACLE[name], duck.connection())

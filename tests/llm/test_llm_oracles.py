"""Queries of this package against their SQL on the smallest supplied tables."""

import os

import pytest

import oracle_check
from pagemill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert oracle_check.compare(spark, oracle_check.database(SF), name, SF) is None

"""Every query against its SQL on the smallest supplied tables."""

import os

import pytest

import __spark_entry__ as entry
import oracle_check

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no supplied tables")


@pytest.fixture(scope="module")
def con():
    return oracle_check.database(SF_DIR)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert oracle_check.compare(spark, con, name, SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["crawl_id", "visited", "saved", "blocked", "failed"]

"""Every registered query against its SQL, on the smallest tables (CHECK_DIR changes them)."""

import os

import pytest

from sessionloom.plans.catalog import CHECKS, QUERIES
from tests.checker import compare, connect

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], CHECKS[name], FOLDER) == []


FITTED = sorted(set(QUERIES) - set(CHECKS))


@pytest.mark.parametrize("name", FITTED)
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)

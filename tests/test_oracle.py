"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from check_oracle import connect, difference

import __spark_entry__ as contract
from affinity.queries import MODULES

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    return connect(str(SF_DIR))


@pytest.mark.parametrize("name", sorted(name for module in MODULES for name in module.QUERIES))
def test_query(spark, sql, name):
    got = contract.queries()[name](spark, str(SF_DIR)).toPandas()
    statement = contract.oracle_sql().get(name)
    if statement is None:
        assert len(got) > 0
    else:
        assert difference(got, sql.execute(statement).df()) is None


def test_every_oracle_has_a_query():
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry(spark):
    assert contract.entry(spark).columns == ["uid", "sim_aid", "pred_rating", "rank"]

"""Every registered query against its SQL twin; a query without rows fails."""

import os

import pytest
from conftest import MEDIUM, SMALL

import __spark_entry__ as entry_module
import check
from ledgerweave.plans import all_plans

WITHOUT_SQL = set()
JOINS = [
    "account_flow", "attach_messages", "unmatched", "matched", "account_edges", "state_diff",
    "state_as_of", "state_as_of_each_hot", "conservation_breaks", "assign_shard", "reachable",
    "trailing_volume_hot", "follow_ups_hot", "account_components",
]


@pytest.fixture(scope="module")
def connection():
    return check.database(MEDIUM)


@pytest.mark.parametrize("name", list(all_plans()))
def test_equals_sql(spark, connection, name):
    assert check.compare(spark, connection, name, MEDIUM) is None


@pytest.mark.parametrize("name", JOINS)
def test_equals_sql_without_broadcast(spark, connection, no_broadcast, name):
    assert check.compare(spark, connection, name, MEDIUM) is None


def test_every_query_has_sql_unless_listed():
    assert set(all_plans()) - set(entry_module.oracle_sql()) == WITHOUT_SQL


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "n_messages", "total_value"]
    assert df.count() > 0
    assert os.path.isdir(SMALL)

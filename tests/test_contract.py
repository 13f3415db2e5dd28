"""Every registered query against its SQL, on whole tables."""

import pytest
from compare import compare, database

import __spark_entry__ as contract
from eventfold.plans.queries import registry

# the queries of the training-data package have tests of their own
QUERIES = {name: query for name, query in contract.queries().items() if name in registry()}
ORACLE = {name: sql for name, sql in contract.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def db(tiny):
    return database(tiny)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, db, tiny, name):
    assert compare(spark, db, tiny, name, QUERIES[name], ORACLE[name]) is None


def test_state_locations(spark, tiny):
    rows = QUERIES["state_locations"](spark, tiny).collect()
    assert {r.key for r in rows} == {"click", "error", "purchase", "signup", "view"}
    assert len(rows) == 5 and all(r.partition_id >= 0 for r in rows)


def test_only_the_hash_dependent_query_has_no_sql():
    assert set(QUERIES) - set(ORACLE) == {"state_locations"}


def test_entry(spark):
    assert contract.entry(spark).count() > 0

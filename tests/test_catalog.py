import pytest

from selvedge.plans import catalog
from tests.compare import database, rows, sql_rows


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    columns, got = rows(catalog.queries()[name](spark, sf))
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert (columns, got) == sql_rows(con, sql)
    assert columns


def test_every_sql_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert {r.decision for r in e.entry(spark).collect()} >= {"candidate_training", "reserved_evaluation"}

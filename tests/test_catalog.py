"""Every registered query against its SQL at the smallest scale."""

import pytest

import catalog
from compare import DATA, arrow, difference, oracle

SF = "0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, f"{DATA}/sf{SF}").toArrow()
    assert got.column_names
    if name in catalog.SQL:
        assert difference(got, arrow(con, catalog.SQL[name])) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query of the core that has SQL gives the same rows in both engines; the others give rows or none."""

import pytest
from compare import same

from telarium import catalog

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, data, name):
    same(QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, data, name):
    assert QUERIES[name](spark, data).limit(5).toPandas().shape[1] > 0


def test_names_are_those_of_the_entry():
    import __spark_entry__ as entry

    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert "a1_term_frequency" in QUERIES

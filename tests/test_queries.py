import os

import pytest

import __spark_entry__ as entry
from palisade import queries as library
from tests.compare import DATA, same

SQL = library.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(library.queries()))
def test_query(spark, name):
    if name in SQL:
        same(library.queries()[name](spark, DATA), SQL[name], DATA)
    else:
        assert library.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(library.queries()) <= set(entry.queries())

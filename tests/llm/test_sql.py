import pytest

from carelattice.llm import queries

from .. import compare
from . import brute


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    got, want = compare.compare(spark, compare.connect(brute.SF), queries.QUERIES[name], queries.SQL[name], brute.SF)
    assert got == want

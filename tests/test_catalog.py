"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import pytest

from carelattice.plans import catalog

from . import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.sql()))
def test_query_equals_sql(spark, con, name):
    got, want = compare.compare(spark, con, catalog.queries()[name], catalog.sql()[name], SF)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.sql())))
def test_other_queries_give_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0

"""Every analytics query gives what its SQL gives in DuckDB, on the smallest tables."""

import oracle
import pytest

from ledgerline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    found = catalogue.queries()[name](spark, SF).toPandas()
    if name in catalogue.oracle_sql():
        assert oracle.differences(found, con.sql(catalogue.oracle_sql()[name]).df()) == ""
    else:
        assert len(found)


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 0

"""Every query of the catalogue against its SQL, or for rows where there is none."""

import oracle
import pytest

from quern.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, name):
    df = catalogue.queries()[name](spark, sf)
    if name in SQL:
        assert oracle.difference(df, sf, SQL[name]) == ""
    else:
        assert df.count() > 0

"""Every registered query of the market and news plans against its SQL, over whole tables."""

import os

import pytest

from tidemark import plans

from .oracle import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = plans.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF).toPandas()
    assert differences(got, duck.sql(SQL[name]).df()) == ""


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    row = __spark_entry__.entry(spark).first()
    assert row.n_rows > 0 and row.n_look_ahead == 0

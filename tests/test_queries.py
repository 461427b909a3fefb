import pytest
from oracle import connect, differ

from lineweave.plans import queries as plans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    if name in plans.SQL:
        assert differ(spark, con, plans.QUERIES[name], plans.SQL[name], SF) == ""
    else:
        assert plans.QUERIES[name](spark, SF).count() > 0

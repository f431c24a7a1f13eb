import pytest

from quantlake.plans import calendar, chains, labels, market, models  # noqa: F401  the others register with market
from tests.helpers import DATA, differences


@pytest.mark.parametrize("name", sorted(market.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert not differences(market.QUERIES[name](spark, DATA), market.ORACLE_SQL[name])[:3]

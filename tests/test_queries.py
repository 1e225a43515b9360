import pytest

import __spark_entry__ as entry
from tests.oracle import assert_same
from tidemark.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, SF, QUERIES[name], ORACLE_SQL[name])


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 1
    assert {*entry.oracle_sql()} <= {*entry.queries()}
    assert {*QUERIES} <= {*entry.queries()}


def test_known_hourly_result(spark):
    r = QUERIES["hourly_momentum_settlement"](spark, "/root/testdata/sf0.01").first()
    assert (r["trades"], r["wins"], r["losses"], r["ties"], r["expectancy"]) == (717, 343, 374, 0, -0.129344)
    r = QUERIES["five_minute_momentum_settlement"](spark, "/root/testdata/sf0.01").first()
    assert (r["trades"], r["wins"], r["losses"], r["expectancy"]) == (896, 454, 442, -0.077813)

import pytest
from oracle import connect, difference

from stratalens.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


#: Of these nothing fits in the few rows of the smallest tables; they are compared on larger ones.
LARGER = {"agg23_group_shares", "flt05_quality_gate", "flt15_leave_one_out", "spj07_latitude_band"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    sf = "/root/testdata/sf0.01" if name in LARGER else SF
    assert difference(spark, connect(sf) if name in LARGER else con, QUERIES[name], ORACLES[name], sf) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)

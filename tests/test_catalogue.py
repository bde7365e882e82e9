import pytest

from mullion.plans.catalogue import ORACLES, QUERIES
from tests.compare import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ours, theirs = both(spark, SF, QUERIES[name], ORACLES[name])
    assert ours == theirs


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert {r.mode for r in entry.entry(spark).collect()} == {"free", "fsm", "prompt_terse"}
    assert set(entry.oracle_sql()) <= set(entry.queries())

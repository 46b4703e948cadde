"""Every registered query next to its SQL on the smallest tables."""

import pytest
from check_oracle import compare, connect

from eventloom.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = list(registry.load())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    status, rows, _, note = compare(spark, con, registry.load()[name], SF)
    assert status in ("ok", "rows-only"), note
    assert rows > 0 or status == "ok"
    assert "types" not in note, note


def test_entry_contract(spark):
    import __spark_entry__ as m

    assert m.entry(spark).count() > 0
    assert set(m.oracle_sql()) <= set(m.queries())

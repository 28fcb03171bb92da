"""Every registered query against its SQL, with tiny chunks so that all keys are split."""

import __spark_entry__ as entry
import pytest
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, monkeypatch, name):
    from clipline.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 30)
    monkeypatch.setattr(ordered, "CHUNKS", 40)
    frame = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    if name in SQL:
        cursor = duck.execute(SQL[name])
        assert compare(rows, frame.columns, cursor.fetchall(), [c[0] for c in cursor.description]) == ""
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0

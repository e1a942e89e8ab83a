"""Every registered query against its DuckDB oracle (row count, columns,
order-blind values) on sf0.001; queries without an oracle must at least run."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"


def _names():
    import __spark_entry__ as E
    return sorted(E.queries())


@pytest.fixture(scope="module")
def duck():
    from oracle_check import duck as mk
    return mk(SF)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from oracle_check import canon
    df = E.queries()[name](spark, SF)
    s_cols, s_rows = canon(df.columns, [tuple(r) for r in df.collect()])
    oracle = E.oracle_sql().get(name)
    if oracle is None:
        return
    cur = duck.execute(oracle)
    d_cols, d_rows = canon([c[0] for c in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert s_rows == d_rows


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["id", "item_name", "stock_total", "in_use", "overdue_2_6", "overdue_7_plus",
                          "available"]

"""Every registered query against its DuckDB oracle (SQL) or, without one, a clean run."""
import pytest

import __spark_entry__ as E
from small_data import SF_SMALL
from oracle import compare

SQL = E.oracle_sql()
NAMES = sorted(E.queries())


def test_every_query_has_a_name_and_sql_subset():
    assert set(SQL) <= set(NAMES)
    assert len(NAMES) >= 80


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_query_matches_oracle(spark, duck, name):
    n, problems = compare(spark, duck, name, E.queries()[name], SQL[name], SF_SMALL)
    assert not problems, problems


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SQL])
def test_query_without_sql_runs(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "max_drawdown" in df.columns

"""Every registered query against its DuckDB oracle (the driver's check)."""

import pytest

import __spark_entry__ as E
from checks.compare import compare, duck
from tests.conftest import SMALL

NAMES = sorted(E.queries())
#: No row of the smallest tables is late enough for the time floor.
NONE_AT_THIS_SCALE = {"f3_since", "f3_since_ts"}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sql = E.oracle_sql().get(name)
    r = compare(spark, SMALL, name, E.queries()[name], sql, con)
    assert r["spark_rows"] > 0 or name in NONE_AT_THIS_SCALE, r
    if sql is not None:
        assert r["match"], r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["symbol", "Date", "rsi_14", "macd", "macd_signal",
                          "bb_upper", "bb_middle", "bb_lower"]
    assert df.count() > 0

"""Every registered query against its DuckDB oracle on the smallest test
tables (the driver runs the same gate at sf0.01)."""
import pytest

from caravan.plans.oracle_check import compare, duck_conn
from caravan.plans.registry import QUERIES, _load_all

SF = "/root/testdata/sf0.001"
_load_all()


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    fn, sql = QUERIES[name]
    r = compare(spark, name, fn, sql, SF, con)
    if sql is None:
        assert r["spark_rows"] >= 0
    else:
        assert r["match"], r


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "lowestPriceBatch" in df.columns
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 90

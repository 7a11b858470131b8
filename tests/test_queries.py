"""Every registered query against its SQL twin on the smallest test tables."""
import pytest
from oracle_compare import compare, connect

from plumbline.workload.catalog import ENTRIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, con, name):
    entry = ENTRIES[name]
    df = entry.run(spark, SF_DIR)
    if entry.sql is None:
        assert df.count() > 0
        return
    _, _, problems = compare(df, con, entry.sql)
    assert not problems


def test_entry_has_stable_schema(spark):
    import __spark_entry__ as contract
    df = contract.entry(spark)
    assert df.columns[:2] == ["qid", "query"] and df.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())

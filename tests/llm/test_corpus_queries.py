"""Corpus queries against their SQL twins; every query on its tables has a row per input row where the contract says so."""
import pytest
from oracle_compare import compare, connect

from plumbline.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(SQL))
def test_twin(spark, con, name):
    _, _, problems = compare(QUERIES[name](spark, SF_DIR), con, SQL[name])
    assert not problems


def test_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, len(QUERIES) + 1))

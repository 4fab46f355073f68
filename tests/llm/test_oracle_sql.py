"""Queries of the operators against their SQL on the smallest given tables."""

import pytest
from compare import differences, duck

from txnlens.llm.oracle import ORACLE
from txnlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert differences(df, con, ORACLE[name]) == []
    else:
        assert df.count() >= 0 and "doc_id" in df.columns

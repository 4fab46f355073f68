"""Every registered query against its SQL on the smallest given tables."""

import pytest
from compare import differences, duck

from txnlens.plans.oracle import ORACLE
from txnlens.plans.registry import QUERIES
from txnlens.plans.reports import hourly_fraud
from txnlens.schemas import FACT_TRANSACTIONS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# One result row over the whole input: partial results meet in one task.
WHOLE_TABLE = {"block_stats", "chunk_stats", "collection_info", "null_audit", "result_profile", "snapshot_counts"}
SEARCHES = {"vec_topk", "vec_rerank", "retrieve", "retrieve_texts", "vec_topk_lsh", "vec_rerank_model"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # No row-at-a-time Python; Arrow only for the ranges of a row's numbers and for matrix products.
    assert "BatchEvalPython" not in plan and ("MapInArrow" in plan) == (name in SEARCHES)
    if name not in WHOLE_TABLE:
        assert "SinglePartition" not in plan
    if name in ORACLE:
        assert differences(df, con, ORACLE[name]) == []
    else:
        assert df.count() > 0


def test_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(QUERIES["agg_merchant"](spark, SF))
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_returnflag:string>" in plan
    # Partial sums come before the shuffle and the join.
    assert plan.index("BroadcastHashJoin") < plan.index("partial_count")
    last = plan_of(QUERIES["fq_last_fraud"](spark, SF))
    assert "EqualTo(l_returnflag,R)" in last and last.count("TakeOrderedAndProject") == 2


def test_filters_on_the_stored_fact_are_pushed(spark, tmp_path):
    path = str(tmp_path / "fact")
    spark.createDataFrame([], FACT_TRANSACTIONS).write.parquet(path)
    fact = spark.read.parquet(path)
    plan = plan_of(hourly_fraud(fact))
    assert "EqualTo(is_fraud,1)" in plan and "ReadSchema: struct<amt:double,is_fraud:smallint,hour:int>" in plan

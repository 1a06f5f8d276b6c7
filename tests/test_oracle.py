"""Every registered query against its DuckDB oracle on the smallest scale."""

import pytest

import __spark_entry__ as E
from compare import SF_SMALL, compare, duck
from jobsift.plans import registry

# the catalog of this library's own operators; the training-data operators have tests of their own
registry.load_all()
QUERIES = dict(registry.QUERIES)
ORACLE = dict(registry.ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle_or_is_listed():
    assert not set(QUERIES) - set(ORACLE)


# Plan shapes no registered query may use: pair-emitting joins and row-wise Python.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    bad = [op for op in FORBIDDEN if op in plan]
    assert not bad, f"{name} plan uses {bad}"
    if name in ORACLE:
        diff = compare(df, con, ORACLE[name])
        assert diff is None, diff
    else:
        assert df.count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["stat", "key", "n", "rank"]
    assert any(r["stat"] == "total" for r in rows)

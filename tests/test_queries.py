"""Every registered query against its SQL on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry
from cyclewise import config
from cyclewise.plans import catalog

# The library's own queries; those of a subpackage that may be absent are tested with it.
SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    rows = QUERIES[name](spark, small)
    if name in SQL:
        # On the smallest tables a filter may leave nothing on either side.
        assert oracle.compare(rows, con, SQL[name]) in (None, "both empty")
    else:
        assert rows.count() > 0


@pytest.mark.parametrize(
    "name",
    ["rul_label", "sliding_windows", "window_features", "late_drop", "dq_monotonic", "last_row_per_unit", "stream_rolling"],
)
def test_query_when_every_key_is_hot(spark, small, con, name, monkeypatch):
    """The same rows when each key is cut into many chunks."""
    monkeypatch.setattr(config, "HOT_ROWS", 5)
    monkeypatch.setattr(config, "CHUNK_ROWS", 33)
    assert oracle.compare(QUERIES[name](spark, small), con, SQL[name]) is None


@pytest.mark.parametrize(
    "name", sorted(n for n in QUERIES if not n.startswith(("stream", "offline", "online_up", "batch_s", "train")))
)
def test_plan(spark, small, name):
    """No cross joins, and no Python in the plan except for the binary codec."""
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("EvalPython" in plan) == (name == "tensor_codec")


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["scan_parquet"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_tax:double,l_shipdate:timestamp_ntz>" in plan


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert QUERIES.keys() <= entry.queries().keys() and SQL.items() <= entry.oracle_sql().items()


def test_entry(spark):
    assert entry.entry(spark).count() > 0

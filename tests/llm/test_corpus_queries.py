"""Registered queries against their SQL, and what must hold for all of them."""

import oracle
import pytest

import __spark_entry__ as entry
from cyclewise.llm import queries


def test_one_for_each_operator():
    names = sorted(queries.queries())
    assert [n for n in names if n == "pipeline"] == ["pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert queries.queries().keys() <= entry.queries().keys()
    assert queries.oracle_sql().items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    assert oracle.compare(queries.queries()[name](spark, small), oracle.connect(small), queries.oracle_sql()[name]) is None

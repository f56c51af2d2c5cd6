"""Queries with oracle SQL against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as E
from tests.llm.helpers import canon, duck

KEYS = [k for k in E.oracle_sql() if k.startswith("op")]


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_oracle(spark, sf_small, key):
    df = E.queries()[key](spark, sf_small)
    got = [tuple(r) for r in df.collect()]
    cols, want = duck(sf_small, E.oracle_sql()[key])
    assert sorted(df.columns) == sorted(cols)
    assert canon(df.columns, got) == canon(cols, want)


def test_every_dealt_operator_has_a_query():
    names = E.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names

"""The operators that SQL can express, against it."""

import os

import pytest

import oracle
from ledgerlens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows(spark, name):
    n, m, names, equal, diff, _ = oracle.compare(spark, oracle.connect(SF), SF, queries.QUERIES[name], queries.SQL[name])
    assert names and n == m and equal, diff

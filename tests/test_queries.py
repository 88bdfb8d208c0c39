"""Each query against its SQL on the smallest tables."""

import os

import pytest

import oracle
from ledgerlens.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows(spark, db, name):
    n, m, names, equal, diff, _ = oracle.compare(spark, db, SF, queries.QUERIES[name], queries.SQL[name])
    assert names and n == m and equal, diff


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_rows_only(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_split_walk_matches_a_plain_loop(spark):
    import datetime as dt
    import random

    from ledgerlens.operators import statement

    r = random.Random(1)
    rows = [(1, i, dt.date(2026, 1, 1) + dt.timedelta(days=r.randint(0, 40)), float(r.randint(1, 9)), f"p{r.randint(0, 30)}") for i in range(900)]
    want = set()
    for party in {x[4] for x in rows}:
        items, i = sorted((x[2], x[1], x[3]) for x in rows if x[4] == party), 0
        while i < len(items):
            j = i
            while j < len(items) and (items[j][0] - items[i][0]).days <= 2:
                j += 1
            if j - i >= 3:
                want.add((party, items[i][0], items[j - 1][0], j - i, sum(x[2] for x in items[i:j])))
                i = j
            else:
                i += 1
    df = spark.createDataFrame(rows, "k int, row_no int, date date, debit double, party string")
    assert {(x.party, x.date_from, x.date_to, x.n, x.total) for x in statement.split_groups(df, ["k"]).collect()} == want

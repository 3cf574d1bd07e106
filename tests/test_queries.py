"""Every registered query against its SQL twin, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {n for n in entry.queries() if not (n.startswith("op") or n == "pipeline")}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda x: round(float(x), 6) + 0.0 if isinstance(x, float) else x
    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(OWN & set(entry.oracle_sql())))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_operator_has_a_query():
    assert len(OWN) >= 65

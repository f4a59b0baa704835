"""Every registered query of the reference operators against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from docloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rounded(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


#: Whole searches, which tests/test_cases.py holds against cases worked out by hand.
WITHOUT_SQL = {"search_ranking", "bridge_expand", "context_packed", "answers"}


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_whole_searches_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(columns)
    order = sorted(columns)
    wanted = sorted((tuple(rounded(dict(zip(columns, r, strict=True))[c]) for c in order) for r in found.fetchall()), key=str)
    got = sorted((tuple(rounded(r[c]) for c in order) for r in frame.collect()), key=str)
    assert got == wanted

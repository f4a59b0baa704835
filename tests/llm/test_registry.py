"""Queries with SQL against it, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from docloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = duck.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    wanted = [tuple(dict(zip((d[0] for d in found.description), r, strict=True))[c] for c in columns) for r in found.fetchall()]
    frame = registry.queries()[name](spark, SF)
    assert sorted(frame.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in frame.collect()) == sorted(wanted)


def test_one_query_for_each_operator():
    assert [int(name[2:].split("_")[0]) for name in registry.queries()] == list(range(1, 11))

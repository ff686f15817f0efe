"""Every registered query of the engine's own operators against its DuckDB twin, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from loomgraph.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else repr(value)
    return None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    mine = QUERIES[name](spark, sf)
    columns = sorted(mine.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in mine.collect()), key=str)
    if name in ORACLES:
        twin = duck.sql(ORACLES[name])
        assert sorted(twin.columns) == columns
        place = [twin.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in place) for r in twin.fetchall()), key=str)
